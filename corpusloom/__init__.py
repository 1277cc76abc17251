"""Document retrieval, vocabulary maintenance and index upkeep as PySpark plans."""
