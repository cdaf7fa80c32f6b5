"""sources of meshlight."""
