"""wardline: identity-risk and fraud analytics as Spark DataFrame jobs."""
