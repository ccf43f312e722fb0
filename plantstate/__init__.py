"""Asset-state analytics on Spark: change rows, constraints, patterns, rules, graphs and alerts."""
