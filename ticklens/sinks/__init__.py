"""Writers: Parquet tables by path and named tables in the catalog."""
