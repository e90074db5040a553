"""Errors of the library, each with the HTTP status and whether a retry may help."""


class ArrowfenError(Exception):
    status, recoverable = 500, False


class InvalidRequestError(ArrowfenError, ValueError):
    status = 400


class UnauthorizedError(ArrowfenError):
    status = 401


class NotFoundError(ArrowfenError, KeyError):
    status = 404


class RateLimitedError(ArrowfenError):
    status, recoverable = 429, True


class StorageError(ArrowfenError):
    pass


class CorruptedDataError(StorageError):
    pass


class IndexStateError(ArrowfenError):
    pass


class EmbeddingError(ArrowfenError):
    status, recoverable = 502, True


class ConfigError(ArrowfenError, ValueError):
    pass


class UnavailableError(ArrowfenError):
    status, recoverable = 503, True
