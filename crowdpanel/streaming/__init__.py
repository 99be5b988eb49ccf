"""Left empty on purpose: the surveyed work is batch only (see README.md)."""
