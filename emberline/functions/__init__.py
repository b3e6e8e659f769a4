"""Functions of the thermal-detection engine."""
