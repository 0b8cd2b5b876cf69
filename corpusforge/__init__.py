"""corpusforge: deterministic corpus analytics expressed as Spark DataFrame plans."""
