"""Column expressions: each helper takes and returns ``Column`` objects."""
