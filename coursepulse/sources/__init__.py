"""Inputs (per-run CSV files, the star-schema test tables) and the Parquet table store."""
