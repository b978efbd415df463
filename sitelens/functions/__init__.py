"""Column-level helpers: every function returns a ``Column`` built from
built-in Spark expressions (no Python UDFs)."""
