"""caravan.streaming."""
