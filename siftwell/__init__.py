"""Record harmonisation, search and retrieval expressed as Spark jobs."""
