"""The append ingest and the volume checks on unbounded tables."""
