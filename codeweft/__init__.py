"""codeweft package."""
