"""siltstone: document intelligence, retrieval and graph operators as PySpark DataFrame plans."""
