"""Query registry (named DataFrame jobs + DuckDB oracle SQL) and plan checks."""
