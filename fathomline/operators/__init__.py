"""operators of the survey engine."""
