"""Torquil: a PySpark library for condition monitoring and corpus work."""
