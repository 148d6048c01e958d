"""Column functions: text, dates and numbers, arrays and vectors, JSON."""
