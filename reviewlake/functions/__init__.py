"""Column functions: paths and text."""
