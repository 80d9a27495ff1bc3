"""Raw-table ingest: CSV scans, load modes and table inventory."""
