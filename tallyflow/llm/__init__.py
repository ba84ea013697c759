"""Operators of a training-data pipeline: dedup, PII, decontamination, licences, tokens, language model, quality.

Nothing else in the library imports this subpackage.
"""
