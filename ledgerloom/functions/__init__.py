"""Column expressions: text, identifiers, times, parsing and vectors."""
