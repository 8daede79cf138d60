"""Spatial, text and vector analytics expressed as PySpark DataFrame plans."""
