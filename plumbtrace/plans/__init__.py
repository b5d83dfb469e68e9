"""Compositions of several operators: full reports, grids and benchmark tables."""
