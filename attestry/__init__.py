"""Evidence, claims and trusted facts as Spark DataFrame jobs."""
