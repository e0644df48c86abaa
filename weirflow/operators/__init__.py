"""Set operators: apply, history, comparison, quality checks."""
