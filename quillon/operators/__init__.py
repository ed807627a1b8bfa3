"""DataFrame operators: inversion, conjunctive search, posting lists."""
