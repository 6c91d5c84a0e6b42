"""Named queries over the tables of the archive, with their SQL."""
