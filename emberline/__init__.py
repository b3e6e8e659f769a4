"""Thermal-detection analytics expressed as Spark DataFrame transforms."""
