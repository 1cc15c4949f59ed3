"""Named query plans (Spark) and their SQL oracles (DuckDB dialect)."""
