"""quillon.operators."""
