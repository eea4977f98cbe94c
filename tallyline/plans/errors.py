"""Request errors with their wire codes."""


class RequestError(ValueError):
    code = -32603


class InvalidRequest(RequestError):
    code = -32600


class InvalidParams(RequestError):
    code = -32602


class NotFound(RequestError):
    """No row answers the request."""
