"""Errors of requests that cannot be carried out as written."""


class RequestError(ValueError):
    """A request that names what is not there, or asks for what is not supported."""
