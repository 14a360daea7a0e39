"""Part of the page engine."""
