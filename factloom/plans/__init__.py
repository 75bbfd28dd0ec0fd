"""Query catalogue, session set-up and lineage helpers."""
