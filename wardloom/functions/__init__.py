"""wardloom.functions."""
