"""Query modules: each gives QUERIES (name -> callable) and SQL (name -> statement)."""
