"""Continuous form of the run."""
