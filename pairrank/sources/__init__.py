"""Table and file readers, writers and integrity checks."""
