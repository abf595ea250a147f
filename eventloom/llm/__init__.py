"""Training-data operators: near-dedup, scoring, formatting, mixing, counting, decontamination."""
