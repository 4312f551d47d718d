"""Column functions: Columns in, Columns out, no UDFs."""
