"""Check and compare successive deliveries of a geo-tagged dataset, as Spark jobs."""
