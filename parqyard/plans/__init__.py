"""Reports and the query catalogue."""
