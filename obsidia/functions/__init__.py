"""Part of obsidia."""
