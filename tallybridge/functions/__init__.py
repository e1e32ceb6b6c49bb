"""Column expressions: cell canonicalisation, equality, text helpers."""
