"""Column expressions: missing values, 365-day calendar, grid geometry, size checks."""
