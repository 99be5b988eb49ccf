"""Column expressions: geography, calendar, text, arrays and statistics."""
