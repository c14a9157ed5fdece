"""streaming of the survey engine."""
