"""Jobs over stored tables, and the query registry over the shared test tables."""
