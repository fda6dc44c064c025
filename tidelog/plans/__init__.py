"""Change logs over plain tables, and the catalogue of queries with their SQL."""
