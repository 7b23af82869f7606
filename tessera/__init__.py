"""Tessera: access-controlled retrieval, versioned business data and text corpora as Spark jobs."""
