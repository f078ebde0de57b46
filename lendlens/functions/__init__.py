"""Column-expression helpers: missing values, labels, schema lists,
special functions and keyed hashing."""
