"""Column expressions: scoring, text rules, bi-temporal predicates, ids."""
