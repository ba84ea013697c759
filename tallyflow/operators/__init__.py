"""Operators over annotated frames: windows, joins, the temporal index, provenance queries, sampling."""
