"""codeweft.plans package."""
