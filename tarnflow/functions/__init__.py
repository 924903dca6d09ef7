"""Column expressions: safe arithmetic, calendar, PET and unit formulas."""
