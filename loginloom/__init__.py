"""Authentication-log analytics on Spark: sources, causal features, rules, graph, evaluation, response."""
