"""wardloom.plans."""
