"""Readers and writers: Parquet tables, CSV ingest, JSON-lines ledger, result sinks."""
