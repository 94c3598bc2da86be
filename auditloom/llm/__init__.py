"""Training-data operators: cleaning, formatting, scoring, mixing, encoding and search of document tables."""
