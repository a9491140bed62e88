"""Features of unbounded series."""
