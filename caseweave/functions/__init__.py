"""Column helpers: dates, ranges and text."""
