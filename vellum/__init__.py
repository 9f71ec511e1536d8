"""vellum: document-image analytics expressed as Spark DataFrame jobs."""
