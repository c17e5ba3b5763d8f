"""wardloom.sources."""
