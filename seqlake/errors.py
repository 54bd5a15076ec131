"""One exception class per kind of failure."""


class StoreError(Exception):
    """Base of all failures; ``kind`` and ``code`` name it for callers and for RPC layers."""

    kind = "Internal"
    code = "INTERNAL"


class InvalidArgument(StoreError):
    kind, code = "InvalidArgument", "INVALID_ARGUMENT"


class NotFound(StoreError):
    kind, code = "NotFound", "NOT_FOUND"


class Corruption(StoreError):
    kind, code = "Corruption", "DATA_LOSS"


class Conflict(StoreError):
    kind, code = "Conflict", "FAILED_PRECONDITION"


class Unavailable(StoreError):
    kind, code = "Unavailable", "UNAVAILABLE"


class IoFailure(StoreError):
    kind, code = "Io", "INTERNAL"


class Internal(StoreError):
    pass
