"""Outcomes of operations, one exception class per status."""

from __future__ import annotations


class StatusError(Exception):
    """An operation that did not succeed; its text is the bare message."""

    code = "IOError"


class NotFound(StatusError):
    code = "NotFound"


class InvalidArgument(StatusError):
    code = "InvalidArgument"


class AlreadyExists(StatusError):
    code = "AlreadyExists"


class IOFailure(StatusError):
    code = "IOError"


class NotSupported(StatusError):
    code = "NotSupported"
