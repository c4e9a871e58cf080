"""Operators for training-data problems 1 to 8; nothing outside this subpackage imports it."""
