"""papergraph: Spark jobs that turn a corpus of papers into queryable tables."""
