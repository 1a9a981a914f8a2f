"""Named queries over the test tables and the SQL each one is checked against."""
