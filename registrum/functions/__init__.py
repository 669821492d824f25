"""Column functions: text normalisation and typed parsers."""
