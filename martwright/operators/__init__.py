"""Marts, metrics, checks, history, reconciliation, measures and lineage."""
