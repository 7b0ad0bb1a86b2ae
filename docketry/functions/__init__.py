"""Column functions: text normalisation, list parsing, codes, dates. All are native expressions."""
