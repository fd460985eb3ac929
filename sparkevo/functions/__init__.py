"""Column expressions and distributed order statistics that the operators share."""
