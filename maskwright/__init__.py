"""Find, mask, check and replace sensitive text in Spark tables."""
