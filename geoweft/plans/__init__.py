"""Named queries with the SQL they are checked against, and the catalog builder."""
