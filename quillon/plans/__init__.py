"""Queries over the catalog, the corpus and the tables, and the SQL that they are held against."""
