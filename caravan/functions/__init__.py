"""caravan.functions."""
