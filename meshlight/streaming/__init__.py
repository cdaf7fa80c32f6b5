"""streaming of meshlight."""
