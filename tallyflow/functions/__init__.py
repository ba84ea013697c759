"""Column functions: time, window arithmetic, annotation algebra, hashes."""
