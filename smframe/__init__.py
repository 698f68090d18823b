"""smframe: strong-motion record processing as Spark DataFrame jobs."""
