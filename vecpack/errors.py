"""What can go wrong, by name."""


class VectorError(Exception):
    """Base of all errors raised here."""


class DimensionMismatch(VectorError, ValueError):
    def __init__(self, expected: int, got: int):
        super().__init__(f"dimension mismatch: expected {expected}, got {got}")
        self.expected, self.got = expected, got


class NotFound(VectorError, KeyError):
    def __init__(self, vec_id: int):
        super().__init__(f"no vector with id {vec_id}")
        self.vec_id = vec_id

    def __str__(self) -> str:
        return self.args[0]


class StorageError(VectorError):
    """A file or table isn't what it should be."""


class ModelMismatch(VectorError):
    """Codes were made by another model than the one that reads them."""


class InvalidVector(VectorError, ValueError):
    """A vector or id that can't be stored: null, with null or non-finite components, or an id out of range."""
