"""Sequence and text operators for preparing training data. Nothing else in wardloom imports this."""
