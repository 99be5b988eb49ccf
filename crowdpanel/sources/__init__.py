"""Readers of landed files and writers of panel tables."""
