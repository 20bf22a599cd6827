"""operators of the score-analytics engine."""
