"""Timeline operators."""
