"""Progress events and incremental scans as streams; aggregations also run on batch tables."""
