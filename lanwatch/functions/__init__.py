"""Column functions: every function takes and returns Column expressions."""
