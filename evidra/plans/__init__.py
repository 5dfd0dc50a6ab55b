"""Named queries and the SQL each is compared with."""
