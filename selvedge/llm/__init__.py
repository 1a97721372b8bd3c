"""Operators for training-data problems; nothing outside this package imports it."""
