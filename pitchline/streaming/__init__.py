"""Live feed: payload flattening, keyed state and streaming jobs."""
