"""Change capture: transforming events, applying whole transactions, reconciling with the source."""
