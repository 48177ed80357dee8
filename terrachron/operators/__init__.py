"""Operators: DataFrame to DataFrame, lazy, for use with ``DataFrame.transform``."""
