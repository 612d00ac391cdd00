"""A Spark-first engine for hiring analytics: text sectioning, retrieval, scheduling and relational queries."""
