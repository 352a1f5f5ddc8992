"""Registered queries: names, builders and their SQL counterparts."""
