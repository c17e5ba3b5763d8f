"""wardloom.streaming."""
