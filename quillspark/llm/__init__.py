"""Training-data operators: ten stages of a corpus pipeline at cluster scale."""
