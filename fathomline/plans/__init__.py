"""plans of the survey engine."""
