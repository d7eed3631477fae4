"""Trade-tape forensics and outcome evaluation as Spark DataFrame jobs."""
