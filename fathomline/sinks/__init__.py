"""sinks of the survey engine."""
