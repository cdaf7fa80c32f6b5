"""plans of meshlight."""
