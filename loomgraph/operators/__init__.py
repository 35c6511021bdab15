"""Relational, graph and stateful operators; each is a pure DataFrame function."""
