"""Sources of the thermal-detection engine."""
