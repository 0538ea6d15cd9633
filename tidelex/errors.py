"""Failures a caller can tell apart."""


class MissingInput(FileNotFoundError):
    """A table, prompt or corpus that was asked for does not exist."""


class MissingColumn(KeyError):
    """A table lacks a column the plan needs."""


class AmbiguousZone(ValueError):
    """A timestamp column carries no zone, so its instant cannot be known."""


class BudgetExceeded(RuntimeError):
    """The next call would push total spend over the cap."""


class EndpointRefused(RuntimeError):
    """The model endpoint refuses in a way that no retry repairs."""
