"""Relational operators over corpus, node, token, report and finding tables."""
