"""quillon.plans."""
