"""Event-time dataflows on Spark whose rows say how much each source contributed to them."""
