"""Column expressions: rules, dates, text and encodings."""
