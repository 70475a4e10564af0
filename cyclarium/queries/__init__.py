"""Queries over the fixture tables, each with the SQL that it must equal."""
