"""Column functions: complex numbers, session keys, special functions."""
