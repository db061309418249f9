"""Readers for text, Word, PDF and Parquet inputs."""
