"""Identity-link risk analytics on payment events, as set-based Spark jobs."""
