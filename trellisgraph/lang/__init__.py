"""Text to syntax trees."""
