"""functions of meshlight."""
