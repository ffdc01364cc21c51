"""Errors that users see."""


class GqlError(Exception):
    """Any rejected statement."""


class ParseError(GqlError):
    def __init__(self, message: str, offset: int):
        super().__init__(f"{message} at byte {offset}")
        self.offset = offset


class InvalidQuery(GqlError):
    """Well-formed text that has no meaning."""


class UnsupportedFeature(GqlError):
    """Part of the language that this engine parses but does not run."""


class NotFound(GqlError):
    """An unknown catalog object."""


class Conflict(GqlError):
    """Another session committed first."""


class ExecutionError(GqlError):
    """A value that cannot be computed, such as an overflow."""
