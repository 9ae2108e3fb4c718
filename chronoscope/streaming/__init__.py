"""Timeline streaming."""
