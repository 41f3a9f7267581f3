"""Table loads."""
