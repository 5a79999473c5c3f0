"""Drift tests in ranges against their folds in one sequence."""

import numpy as np
import pandas as pd
import pytest

from flowwatch.streaming import ranges
from flowwatch.streaming.folds import Adwin, KsWindow


def streams():
    """Noise with jumps, a long quiet key, ties, a key shorter than a window, missing scores, and no key."""
    rng = np.random.default_rng(5)
    quiet = rng.normal(0, 1, 4000)
    jumps = np.concatenate([rng.normal(m, 0.3, n) for m, n in ((0, 700), (3, 333), (3.2, 900), (0, 411), (8, 1500))])
    late = np.concatenate([rng.normal(0, 0.2, 3100), rng.normal(2, 0.2, 400)])
    ties = np.repeat([0.0, 0.0, 1.0, 2.0, 0.5], 260)
    holes = np.where(np.arange(900) % 400 == 390, np.nan, rng.normal(0, 1, 900))
    return {"quiet": quiet, "jumps": jumps, "late": late, "ties": ties, "short": quiet[:30], "holes": holes, None: quiet[:700] * 4}


def table(spark, parts):
    rows = pd.concat([pd.DataFrame({"key": pd.Series([k] * len(x), dtype=object), "i": np.arange(len(x)), "score": x})
                      for k, x in parts.items()])
    rows["i"] = np.arange(len(rows))
    shuffled = rows.sample(frac=1.0, random_state=1)
    listed = [(k, int(i), None if np.isnan(s) else float(s)) for k, i, s in shuffled.itertuples(index=False)]
    return spark.createDataFrame(listed, "key string, i long, score double")


@pytest.mark.parametrize("block", [210, 400, 100_000])
def test_adwin_in_ranges_equals_the_fold(spark, block):
    test, parts = Adwin(delta=0.01, max_window=200, cadence=10, min_window=20, scale=0.7), streams()
    got = {(r["key"], r["step"]) for r in ranges.adwin_alarms(table(spark, parts), "key", "i", "i", test, block=block).collect()}
    want = {(k, a + 1) for k, x in parts.items() for a in test.run(test.start(), x)[1]}
    assert got == want and {"jumps", "late"} <= {k for k, _ in want}


def test_quiet_ranges_are_not_folded(spark, monkeypatch):
    """The number of rounds is that of ranges that may hold a cut, not that of all ranges."""
    paths = []
    real = ranges.scratch_path
    monkeypatch.setattr(ranges, "scratch_path", lambda s, n: paths.append(real(s, n)) or paths[-1])
    test = Adwin(delta=0.01, max_window=200, cadence=10, min_window=20, scale=2.0)
    x = np.random.default_rng(1).normal(0, 1, 6000)
    x[4500:] += 20
    ranges.adwin_alarms(table(spark, {"a": x}), "key", "i", "i", test, block=300).collect()
    import os
    rounds = sum(f.startswith("round-") for f in os.listdir(paths[-1]))
    assert rounds < 8 < 6000 // 300
    assert [a + 1 for a in test.run(test.start(), x)[1]] == [
        r["step"] for r in ranges.adwin_alarms(table(spark, {"a": x}), "key", "i", "i", test, block=300).orderBy("step").collect()]


def test_a_range_is_passed_only_when_no_check_can_find_a_split():
    rng = np.random.default_rng(3)
    test = Adwin(delta=0.01, max_window=200, cadence=10, min_window=20, scale=0.5)
    for shift in (0.0, 0.15, 0.3, 0.6):
        x = rng.normal(0, 1, 600)
        x[400:] += shift
        reach = ranges.split_reach(test, x[:200], x[200:], 200)
        for checks in (0, 10, 1000, 10 ** 5, 10 ** 8):
            state = {"window": x[:200].tolist(), "t": 200, "checks": checks, "pending": False}
            after, _ = test.run(state, x[200:])
            untouched = after["checks"] == checks + 40 * 161 and not after["pending"] and len(after["window"]) == 200
            assert untouched == (checks > reach)


@pytest.mark.parametrize("block,cadence,size", [(130, 25, 100), (100_000, 25, 100), (211, 7, 60), (64, 1, 20)])
def test_ks_windows_in_ranges_equal_the_fold(spark, block, cadence, size):
    base = np.round(np.random.default_rng(2).normal(0, 1, 300), 1)
    test, parts = KsWindow(base, alpha=0.01, window=size, cadence=cadence), {
        k: np.round(x, 1) for k, x in streams().items()}
    got = {(r["key"], r["step"]): (r["distance"], r["ks_p"], r["alarm"]) for r in ranges.ks_window_tests(
        table(spark, parts), "key", "i", "i", test, block=block).collect()}
    want = {}
    for k, x in parts.items():
        tested = []
        _, alarms = test.run(test.start(), x, tested)
        want |= {(k, at + 1): (p, (at, p) in alarms) for at, p in tested}
    assert got.keys() == want.keys()
    assert all(got[w][1] == pytest.approx(want[w][0], abs=1e-12) and got[w][2] == want[w][1] for w in want)
    assert {f for _, _, f in got.values()} == {True, False}


def test_empty_streams(spark):
    none = spark.createDataFrame([], "key string, i long, score double")
    assert ranges.adwin_alarms(none, "key", "i", "i", Adwin()).count() == 0
    assert ranges.ks_window_tests(none, "key", "i", "i", KsWindow(np.arange(5.0))).count() == 0
