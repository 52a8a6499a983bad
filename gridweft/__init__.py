"""Gridweft: a PySpark-native engine for power-grid models held as object and triple tables."""
