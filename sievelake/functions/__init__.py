"""Column functions: Catalyst expressions only."""
