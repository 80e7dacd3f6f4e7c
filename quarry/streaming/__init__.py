"""Continuous forms of the change pipeline and of the click log."""
