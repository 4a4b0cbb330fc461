"""DataFrame to DataFrame operators, by family."""
