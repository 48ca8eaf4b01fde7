"""A retrieval-data engine on Spark: corpora, long-context benchmarks, retrieval measures and analysis."""
