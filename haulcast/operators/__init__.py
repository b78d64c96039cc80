"""Table operators: each takes a DataFrame and returns a DataFrame or a fitted model."""
