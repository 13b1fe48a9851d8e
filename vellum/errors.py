"""Errors of the engine."""


class SpecError(ValueError):
    """A filter, pipeline, update or schema that can't be compiled."""


class ConflictError(RuntimeError):
    """A collection was changed by someone else since it was read."""


class DuplicateKeyError(ValueError):
    """A unique index has a key more than once."""
