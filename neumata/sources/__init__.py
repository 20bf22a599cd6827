"""sources of the score-analytics engine."""
