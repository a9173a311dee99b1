"""Training-data operators: tokenisation, deduplication, classification, mixing and search over document tables."""
