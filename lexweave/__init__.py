"""lexweave: terminology-aware text analytics expressed as Spark DataFrame plans."""
