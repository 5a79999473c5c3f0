"""Drift folds, batch and streaming monitors, guarded adaptation."""
