"""Readers and writers of tables, rasters, configurations and model files."""
