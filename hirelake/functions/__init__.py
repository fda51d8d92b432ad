"""Column functions: text, dates, locations and distributed positions."""
