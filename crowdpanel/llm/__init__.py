"""Operators for preparing training text, each by one stated method; nothing else in the library imports them."""
