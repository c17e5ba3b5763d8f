"""wardloom.operators."""
