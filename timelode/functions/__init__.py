"""Column functions: text rules, dates, identifiers."""
