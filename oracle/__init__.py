"""SQL checks, written for DuckDB independently of the Spark operators."""
