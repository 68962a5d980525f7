"""Column functions: keys, routing, numbers and hashes."""
