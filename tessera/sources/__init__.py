"""Sources: files as documents, paged HTTP resources, graph tables and JSON lists."""
