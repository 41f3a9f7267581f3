"""File listings, ingest planning and CSV readers."""
