"""What the library raises."""


class SamplerError(Exception):
    """Any failure of sampling."""


class ConfigurationError(SamplerError, ValueError):
    """A setting that cannot work."""


class InvalidWeight(SamplerError, ValueError):
    """A mixing weight that is negative or names no source."""


class Exhausted(SamplerError):
    """No sample can be drawn."""


class StateError(SamplerError):
    """Stored state that doesn't fit the settings."""
