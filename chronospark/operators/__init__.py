"""Blocks: columns, features, scaling, selection, models, composites, events and samplers."""
