"""Tables whose files keep arriving."""
