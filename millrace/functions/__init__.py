"""Column functions: text, arrays, statistics and validators."""
