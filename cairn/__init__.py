"""Analytics over embeddings and text on Spark: geometry, retrieval architectures, duplicates, chunks, verdicts."""
