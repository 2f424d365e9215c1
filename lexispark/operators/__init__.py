"""Relational operators: scoring, matching, retrieval, fusion, tuning, spans, splits."""
