"""caravan.plans."""
