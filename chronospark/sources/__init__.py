"""Where series come from: files, cleaning steps, and generated ones for tests."""
