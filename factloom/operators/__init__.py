"""Relational operators: texts, chunks, judging, resolution, grounding, graph tables, statistics."""
