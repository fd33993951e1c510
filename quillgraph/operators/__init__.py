"""Graph operators on edge tables."""
