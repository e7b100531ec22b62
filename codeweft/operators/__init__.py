"""codeweft.operators package."""
