"""Column expressions: text, dates, identity, vectors and collections."""
