"""caravan.sources."""
