"""DataFrame operators: cleaning, RFM aggregation, ranks, scores, rules and
the anchored rate limiter."""
