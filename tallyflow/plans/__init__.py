"""The dataflows, and their instances on the star-schema tables."""
