"""Our streaming surface over the batch operators."""
