"""From SQL text to a plan of operators."""
