"""Queries over the standard tables, with equivalent SQL."""
