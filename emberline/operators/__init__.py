"""Operators of the thermal-detection engine."""
