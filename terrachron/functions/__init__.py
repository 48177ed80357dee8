"""Column expressions: they take and return Columns (or SQL text) and never start a job."""
