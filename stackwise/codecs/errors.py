class RecordError(ValueError):
    """A record that cannot be read or written."""
