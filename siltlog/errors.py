"""What goes wrong, by kind."""


class StoreError(Exception):
    """Any failure of a store."""


class ColumnFamilyNotFound(StoreError):
    """A read or write named a column family that the store was not opened with."""


class ConfigError(StoreError):
    """A declaration that can't hold."""


class CorruptionError(StoreError):
    """Data or a manifest that does not check out."""


class RejectedError(StoreError):
    """A call that this handle doesn't take."""


class LockHeldError(StoreError):
    """Another writer owns the store."""
