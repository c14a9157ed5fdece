"""sources of the survey engine."""
