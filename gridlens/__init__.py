"""Analytics of three-phase power-quality sessions on Spark."""
