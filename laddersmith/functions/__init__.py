"""Column functions: times, names, scores, rating formulas."""
