"""Training-data operators: deduplication, scoring, mixing, search and tokenising on Spark."""
