"""codeweft.functions package."""
