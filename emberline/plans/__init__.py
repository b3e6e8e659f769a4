"""Plans of the thermal-detection engine."""
