"""operators of meshlight."""
