"""Errors shown to users, as opposed to errors of the library itself."""


class UserError(Exception):
    """Wrong input: a bad specification, an unknown table, a faulty query."""


class InternalError(Exception):
    """A state the library should never reach."""
