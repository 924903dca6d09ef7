"""Readers and writers: ESRI ASCII, discharge text, namelists, metric CSV, long Parquet grids."""
