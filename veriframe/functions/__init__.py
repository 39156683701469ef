"""Column expressions: text, rules, statistics, similarity."""
