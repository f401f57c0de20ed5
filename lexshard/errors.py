"""What can go wrong."""

from __future__ import annotations


class LexshardError(Exception):
    """Base of this library's errors."""


class DuplicateTerm(LexshardError):
    """A batch names a term twice."""


class EmptyIndex(LexshardError):
    """A writer was closed before anything was put into it."""


class BadInput(LexshardError):
    """A term or value that can't be indexed: null or empty terms, null or NaN values, values out of bounds."""


class Closed(LexshardError):
    """A handle was used, or closed, after it was closed."""


class Corrupted(LexshardError):
    """A shard or manifest lacks parts, or they don't fit together."""


class Conflict(LexshardError):
    """Another process changed the directory so that a commit no longer applies."""
