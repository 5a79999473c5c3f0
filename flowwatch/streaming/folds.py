"""Drift detectors as folds ``run(state, values) -> (state, alarm offsets)``.

The state is a plain dict of numbers and lists, so it can be stored as JSON
between micro-batches or segments. Each fold works on whole arrays and only
loops over alarms or scheduled checks. Batch jobs and streams share the folds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd

from flowwatch.functions.ks import ks_p_values, window_distances

_CHUNK = 4096
#: By length of a full adaptive window: its splits and the weights of their gaps.
_SPLITS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


@dataclass
class PageHinkley:
    """One-sided test for a rising mean; an alarm restarts everything."""

    tau: float = 40.0
    lam: float = 0.1
    warmup: int = 150

    def start(self) -> dict:
        return {"n": 0, "mean": 0.0, "sum": 0.0, "low": 0.0}

    def run(self, state: dict, values: np.ndarray) -> tuple[dict, list[int]]:
        n, mean, total, low = state["n"], state["mean"], state["sum"], state["low"]
        alarms, at = [], 0
        while at < len(values):
            x = values[at:at + _CHUNK]
            seen = n + np.arange(1, len(x) + 1)
            means = (n * mean + np.cumsum(x)) / seen
            armed = seen > self.warmup
            sums = total + np.cumsum(np.where(armed, x - means - self.lam, 0.0))
            lows = np.minimum(low, np.minimum.accumulate(np.where(armed, sums, np.inf)))
            hit = np.flatnonzero(armed & (sums - lows > self.tau))
            if len(hit):
                alarms.append(at + int(hit[0]))
                at += int(hit[0]) + 1
                n, mean, total, low = 0, 0.0, 0.0, 0.0
            else:
                at += len(x)
                n, mean, total, low = int(seen[-1]), float(means[-1]), float(sums[-1]), float(lows[-1])
        return {"n": n, "mean": mean, "sum": total, "low": low}, alarms


@dataclass
class PageHinkleyDecrease:
    """Alarm when the running mean falls ``threshold`` below its maximum.

    After an alarm the mean and the maximum restart at the value; the count goes on.
    """

    baseline_mean: float
    threshold: float = 50.0
    warmup: int = 500

    def start(self) -> dict:
        return {"n": 0, "mean": self.baseline_mean, "high": self.baseline_mean}

    def run(self, state: dict, values: np.ndarray) -> tuple[dict, list[int]]:
        n, mean, high = state["n"], state["mean"], state["high"]
        alarms, at = [], 0
        while at < len(values):
            x = values[at:at + _CHUNK]
            seen = n + np.arange(1, len(x) + 1)
            means = (n * mean + np.cumsum(x)) / seen
            highs = np.maximum(high, np.maximum.accumulate(means))
            hit = np.flatnonzero((seen > self.warmup) & (highs - means > self.threshold))
            if len(hit):
                i = int(hit[0])
                alarms.append(at + i)
                at += i + 1
                n, mean, high = int(seen[i]), float(x[i]), float(x[i])
            else:
                at += len(x)
                n, mean, high = int(seen[-1]), float(means[-1]), float(highs[-1])
        return {"n": n, "mean": mean, "high": high}, alarms


@dataclass
class Adwin:
    """Adaptive window: two checks in a row must find a split with a large mean gap."""

    delta: float = 0.0005
    max_window: int = 5000
    cadence: int = 50
    min_window: int = 150
    scale: float = 1.0

    def start(self) -> dict:
        return {"window": [], "t": 0, "checks": 0, "pending": False}

    def _calm(self, window: np.ndarray, checks: int) -> bool:
        """Whether no split comes near the bound. The gap and the bound, both times ``k * (len - k)``, need no division of
        their own for each split; what is near the bound or not a number is left to ``_split``."""
        n, m = len(window), self.min_window
        if n != self.max_window or n < 2 * m or self.scale <= 0:
            return False
        if n not in _SPLITS:
            every = np.arange(1.0, n)
            _SPLITS[n] = every, 1.0 / np.sqrt(n * every * (n - every) / 2.0)
        every, weight = (a[m - 1:n - m] for a in _SPLITS[n])
        sums = np.cumsum(window)
        far = np.abs(sums[m - 1:n - m] * n - sums[-1] * every) * weight
        limit = self.scale * math.sqrt(math.log(4.0 * max(1, checks) / self.delta))
        return bool(far.max() < limit * (1.0 - 1e-6))

    def _split(self, window: np.ndarray, checks: int) -> int | None:
        if self._calm(window, checks):
            return None
        k = np.arange(self.min_window, len(window) - self.min_window + 1)
        if not len(k):
            return None
        sums = np.cumsum(window)
        n1 = len(window) - k
        gap = np.abs(sums[k - 1] / k - (sums[-1] - sums[k - 1]) / n1)
        budget = math.log(4.0 * max(1, checks) / self.delta)
        bound = self.scale * np.sqrt((1.0 / k + 1.0 / n1) / 2.0 * budget)
        hit = np.flatnonzero(gap >= bound)
        return int(k[hit[0]]) if len(hit) else None

    def run(self, state: dict, values: np.ndarray) -> tuple[dict, list[int]]:
        window = np.asarray(state["window"], dtype=float)
        t, checks, pending = state["t"], state["checks"], state["pending"]
        alarms, at = [], 0
        while at < len(values):
            take = min(self.cadence - t % self.cadence, len(values) - at)
            window = np.concatenate([window, values[at:at + take]])[-self.max_window:]
            t, at = t + take, at + take
            if t % self.cadence or len(window) < self.min_window:
                continue
            checks += max(0, len(window) - 2 * self.min_window + 1)
            split = self._split(window, checks)
            if split is None:
                pending = False
            elif not pending:
                pending, checks = True, 0
            else:
                window, pending, checks = window[split:], False, 0
                alarms.append(at - 1)
        return {"window": window.tolist(), "t": t, "checks": checks, "pending": pending}, alarms


@dataclass
class KsWindow:
    """KS test of the latest scores against a frozen baseline, every ``cadence`` values."""

    baseline: np.ndarray
    alpha: float = 0.001
    window: int = 1000
    cadence: int = 25

    def start(self) -> dict:
        return {"recent": [], "t": 0, "p": None, "base": None}

    def run(self, state: dict, values: np.ndarray, tested: list | None = None) -> tuple[dict, list[tuple[int, float]]]:
        """``tested`` takes every test's place and p-value, alarm or not. No test waits for another: the ranks of all
        values in the baseline are found once, and the windows are sorted many at a time."""
        base, counts = np.unique(np.asarray(self.baseline if state["base"] is None else state["base"], dtype=float),
                                 return_counts=True)
        upto = np.concatenate([[0], np.cumsum(counts)])
        held = np.asarray(state["recent"], dtype=float)
        line, t, p, alarms = np.concatenate([held, values]), state["t"], state["p"], []
        seen = np.arange(self.cadence - t % self.cadence, len(values) + 1, self.cadence)  # new values at each test
        seen = seen[len(held) + seen >= self.window]
        if len(seen):
            rest = line[len(held) + seen[0] - self.window:]
            codes = np.searchsorted(base, rest, side="left") + np.searchsorted(base, rest, side="right")
            found = window_distances(codes, upto, self.window, self.cadence)[:len(seen)]
            ps = ks_p_values(found, int(upto[-1]), self.window)
            if tested is not None:
                tested.extend(zip((seen - 1).tolist(), ps.tolist(), strict=True))
            hit = ps < self.alpha
            alarms, p = list(zip((seen[hit] - 1).tolist(), ps[hit].tolist(), strict=True)), float(ps[-1])
        return {"recent": line[-self.window:].tolist(), "t": t + len(values), "p": p, "base": state["base"]}, alarms


@dataclass
class SingleFold:
    """One detector over one score column, with its alarms as events."""

    detector: object
    name: str = "drift"

    def start(self) -> dict:
        return self.detector.start()

    def run(self, state: dict, rows: pd.DataFrame) -> tuple[dict, list]:
        state, alarms = self.detector.run(state, rows["score"].to_numpy(dtype=float))
        out = []
        for a in alarms:
            offset, p = a if isinstance(a, tuple) else (a, None)
            details = {"score": float(rows["score"].iloc[offset])}
            if p is not None:
                details["ks_p"] = p
            out.append((offset, [self.name], details))
        return state, out


@dataclass
class SensitivityFold:
    """The same test at several thresholds in one pass."""

    detectors: dict = field(default_factory=dict)

    def start(self) -> dict:
        return {k: d.start() for k, d in self.detectors.items()}

    def run(self, state: dict, rows: pd.DataFrame) -> tuple[dict, list]:
        values, new, out = rows["score"].to_numpy(dtype=float), {}, []
        for name, detector in self.detectors.items():
            new[name], alarms = detector.run(state[name], values)
            out += [(a, [name], {}) for a in alarms]
        return new, sorted(out, key=lambda e: (e[0], e[1]))


@dataclass
class ScoreMonitor:
    """Score, alert rate, adaptive window and KS detectors, merged per step.

    Columns read: ``score``, optional ``flag`` (else ``score >= threshold``) and
    optional ``rearm`` (1 = re-arm all detectors after this row).
    """

    threshold: float
    score_test: PageHinkley = field(default_factory=PageHinkley)
    alert_test: PageHinkley = field(default_factory=lambda: PageHinkley(tau=15.0, lam=0.005))
    adwin: Adwin | None = field(default_factory=lambda: Adwin(delta=0.002))
    ks: KsWindow | None = None

    def _parts(self) -> dict:
        parts = {"ph_score": self.score_test, "ph_alert_rate": self.alert_test,
                 "adwin": self.adwin, "ks_window": self.ks}
        return {k: v for k, v in parts.items() if v is not None}

    def start(self) -> dict:
        state = {name: part.start() for name, part in self._parts().items()}
        state["threshold"] = self.threshold
        return state

    def rearm(self, state: dict, threshold: float | None = None, baseline=None) -> dict:
        """Fresh detectors; the KS window keeps its latest scores and may get a new baseline."""
        fresh = self.start()
        fresh["threshold"] = state["threshold"] if threshold is None else float(threshold)
        if self.ks is not None:
            fresh["ks_window"] = dict(state["ks_window"])
            if baseline is not None:
                fresh["ks_window"]["base"] = [float(v) for v in baseline]
        return fresh

    def run(self, state: dict, rows: pd.DataFrame) -> tuple[dict, list]:
        if "rearm" not in rows.columns or not rows["rearm"].fillna(0).to_numpy().any():
            return self._span(state, rows, 0)
        out, at = [], 0
        for stop in [*np.flatnonzero(rows["rearm"].fillna(0).to_numpy() == 1) + 1, len(rows)]:
            state, events = self._span(state, rows.iloc[at:stop], at)
            out += events
            if stop <= len(rows) and stop > at and rows["rearm"].iloc[stop - 1] == 1:
                state = self.rearm(state)
            at = stop
        return state, out

    def _span(self, state: dict, rows: pd.DataFrame, base: int) -> tuple[dict, list]:
        scores = rows["score"].to_numpy(dtype=float)
        flags = scores >= state["threshold"]
        if "flag" in rows.columns:
            known = rows["flag"].notna().to_numpy()
            flags = np.where(known, rows["flag"].fillna(0).to_numpy() > 0, flags)
        new, fired, tested = dict(state), {}, []
        for name, part in self._parts().items():
            more = {"tested": tested} if name == "ks_window" else {}
            new[name], alarms = part.run(state[name], flags.astype(float) if name == "ph_alert_rate" else scores, **more)
            for a in alarms:
                fired.setdefault(a[0] if isinstance(a, tuple) else a, []).append(name)
        events, last_p, t = [], state["ks_window"]["p"] if self.ks is not None else None, 0
        for offset in sorted(fired):
            while t < len(tested) and tested[t][0] <= offset:
                last_p, t = tested[t][1], t + 1
            details = {"score": float(scores[offset])} | ({} if last_p is None else {"ks_p": last_p})
            events.append((base + offset, fired[offset], details))
        return new, events
