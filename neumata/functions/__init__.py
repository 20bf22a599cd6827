"""functions of the score-analytics engine."""
