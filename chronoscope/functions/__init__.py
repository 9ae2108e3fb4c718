"""Timeline functions."""
