"""caravan.operators."""
