"""Training-data operators: cleaning, deduplication, scoring, packing and token output."""
