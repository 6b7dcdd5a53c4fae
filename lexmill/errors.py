"""Errors raised on the driver, before a plan is built."""


class LexmillError(Exception):
    """Base of all errors of this package."""


class ConfigError(LexmillError, ValueError):
    """A profile's settings don't hold together."""


class UnknownProfileError(LexmillError, ValueError):
    """No enabled profile has the given name."""


class PdfSupportError(LexmillError, RuntimeError):
    """The library that reads PDF pages isn't installed."""
