"""statloom: public-statistics analytics expressed as Spark DataFrame jobs."""
