"""Operators for language-model data: text, membership and cardinality at corpus size. Nothing outside this package imports it."""
