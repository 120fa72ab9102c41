"""Messages as streams."""
