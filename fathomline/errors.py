class ProcessingError(Exception):
    """A condition the user can act on; the message says which."""
