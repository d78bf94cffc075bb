"""Fixed texts."""
