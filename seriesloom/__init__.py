"""Analytics for ordered, grouped series as Spark DataFrame plans."""
