"""Registered queries: operators applied to the test tables, and their SQL counterparts."""
