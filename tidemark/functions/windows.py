"""Which functions need OVER."""

# Fixed values.
RANKING = {"row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile"}
OFFSET = {"lag", "lead"}
VALUE = {"first_value", "last_value", "nth_value"}
WINDOW_ONLY = RANKING | OFFSET | {"nth_value"}
