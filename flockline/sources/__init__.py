"""Reading, writing and state tables."""
