"""Fixed reference values."""
