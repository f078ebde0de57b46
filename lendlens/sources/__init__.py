"""Scans, the derived ``loans`` table, CSV/Parquet round trips."""
