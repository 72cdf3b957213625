"""Column functions and pattern catalogues."""
