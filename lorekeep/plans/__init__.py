"""Queries over the supplied tables: every operator bound to them, with the SQL that gives the same rows."""
