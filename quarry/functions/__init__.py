"""Column functions on lists per row and on four-vectors."""
