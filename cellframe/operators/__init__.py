"""Tables of points, boxes and multimaps, and what can be asked of them."""
