"""codeweft.sources package."""
