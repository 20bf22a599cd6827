"""plans of the score-analytics engine."""
