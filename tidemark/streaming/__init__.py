"""Incremental maintenance: weighted rows, delta rules, versioned state, and the loop that applies committed transactions."""
