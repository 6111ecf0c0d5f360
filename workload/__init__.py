"""Queries that run the library's operators over the generated tables, each with equivalent SQL."""
