"""Operators that prepare training text: scoring, tokens, duplicates, licences, media and packing."""
