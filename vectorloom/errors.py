"""Typed errors of the engine."""


class EngineError(Exception):
    """Any error that the engine raises itself."""


class InvalidArgument(EngineError, ValueError):
    """A value outside of what an operation takes."""


class NotFound(EngineError, KeyError):
    """A collection or row that isn't there."""


class AlreadyExists(EngineError):
    """A collection or row that is there already."""


class CorruptFile(EngineError, ValueError):
    """A tensor file that breaks its own format."""
