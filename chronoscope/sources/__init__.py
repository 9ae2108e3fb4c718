"""Timeline sources."""
