"""CSV and Parquet sources, snapshots, the manifest and the version registry."""
