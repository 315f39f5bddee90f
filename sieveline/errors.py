"""Errors that callers can tell apart."""


class EngineError(Exception):
    """Base of all errors raised on purpose."""


class ConfigurationError(EngineError):
    pass


class PluginNotFoundError(EngineError):
    pass


class UnsupportedFileTypeError(EngineError):
    pass


class DocumentParseError(EngineError):
    pass


class ConnectorAuthError(EngineError):
    pass


class TransientError(EngineError):
    """Worth another attempt."""


class EmbeddingError(EngineError):
    pass


class ProviderUnavailableError(EmbeddingError):
    pass


class StorageError(EngineError):
    pass


class DimensionMismatchError(StorageError):
    def __init__(self, expected: int, got: int):
        super().__init__(f"vectors of {got} dimensions, the model has {expected}")
        self.expected, self.got = expected, got


class DatasetError(EngineError):
    pass


class LabelError(EngineError):
    pass
