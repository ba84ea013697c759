"""Readers, generators, arrival harness and sinks."""
