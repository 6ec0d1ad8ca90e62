"""Ball-by-ball analytics on Spark."""
