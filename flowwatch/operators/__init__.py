"""DataFrame operators: profile, clean, split, features, detectors, fusion, metrics."""
