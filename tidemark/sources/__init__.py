"""Source tables and their change log."""
