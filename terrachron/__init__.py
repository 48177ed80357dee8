"""terrachron: time-series and training-data analytics as lazy PySpark DataFrame transformations."""
