"""Inputs: parquet tables, the derived store view, site tables, CSV ingest."""
