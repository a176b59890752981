"""lagline: delayed-label transaction analytics on Spark."""
