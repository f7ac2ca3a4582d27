"""corpusloom: corpus and batch analytics expressed as Spark plans."""
