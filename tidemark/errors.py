"""Exceptions of the library; all are raised on the driver, never inside a task."""


class TidemarkError(Exception):
    """Base class."""


class ConfigError(TidemarkError):
    """A configuration value or a parameter is not usable."""


class SchemaError(TidemarkError):
    """A table does not have the registered columns, types or null-freedom."""


class InvariantViolation(TidemarkError):
    """A data-quality check found rows that break it."""


class FutureAccessError(TidemarkError):
    """Something later than the cutoff of a view was asked for."""
