"""One-class detectors: fitted on benign rows, score any row, higher = more anomalous."""

from flowwatch.operators.detect.base import Detector, arrow_score
from flowwatch.operators.detect.forest import IsolationForest
from flowwatch.operators.detect.hybrid import HybridDetector
from flowwatch.operators.detect.mixture import GaussianMixtureDetector
from flowwatch.operators.detect.simple import CenterDistance, MahalanobisDetector, ZScoreMax
from flowwatch.operators.detect.svm import OneClassSvm
from flowwatch.operators.detect.windows import WindowReconstruction

__all__ = [
    "CenterDistance", "Detector", "GaussianMixtureDetector", "HybridDetector", "IsolationForest",
    "MahalanobisDetector", "OneClassSvm", "WindowReconstruction", "ZScoreMax", "arrow_score",
]
