"""Column functions: text, overlaps, document contexts, scorers, rewards."""
