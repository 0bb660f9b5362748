"""worklake: a PySpark engine for operational lakehouses that rank work."""
