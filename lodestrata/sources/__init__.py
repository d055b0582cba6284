"""Readers, writers, footers and metadata of level-of-detail Parquet files."""
