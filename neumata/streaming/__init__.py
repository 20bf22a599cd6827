"""streaming of the score-analytics engine."""
