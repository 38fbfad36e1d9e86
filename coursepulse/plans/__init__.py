"""Whole analyses: the derived tables of a course, the report on them, and the query registry."""
