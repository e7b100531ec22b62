"""codeweft.streaming package."""
