"""Column functions: texts, arrays and stop words."""
