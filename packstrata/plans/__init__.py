"""Queries: operators applied to tables, each with the SQL that says the same."""
