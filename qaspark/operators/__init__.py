"""DataFrame operators: each function takes and returns ``DataFrame`` objects."""
