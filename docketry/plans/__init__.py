"""The query catalogue: each query applies operators of this package to tables of a folder of Parquet files."""
