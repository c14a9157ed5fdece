"""functions of the survey engine."""
