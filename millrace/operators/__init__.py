"""Relational operators as registered queries: each module lists (name, DataFrame builder, SQL for the oracle)."""
