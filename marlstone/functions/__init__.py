"""Column functions: text normalisation, extraction, report vocabulary."""
