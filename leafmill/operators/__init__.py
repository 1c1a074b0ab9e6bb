"""Relational building blocks and document operators."""
