"""Error taxonomy. The leaf errors are also ``ValueError`` (``StorageError`` a ``RuntimeError``)."""


class PolyadError(Exception):
    """Base of all errors raised by this package."""


class MissingNodeError(PolyadError, ValueError):
    """A node is not part of the hypergraph."""


class MissingEdgeError(PolyadError, ValueError):
    """An edge is not part of the hypergraph."""


class InvalidFormatError(PolyadError, ValueError):
    """The content of a file does not follow its format."""


class InvalidFileTypeError(PolyadError, ValueError):
    """The kind of a file is not known."""


class StorageError(PolyadError, RuntimeError):
    """Reading or writing failed."""


class InvalidParameterError(PolyadError, ValueError):
    """A parameter, or a combination of parameters, is not valid."""
