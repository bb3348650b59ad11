"""Column functions: missing values, named aggregates, timestamps and distributions."""
