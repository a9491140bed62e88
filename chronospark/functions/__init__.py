"""Column functions: names and selectors, window aggregates, guarded arithmetic, dates."""
