"""Errors of the library."""


class LodestoneError(Exception):
    """Base of all."""


class ConfigError(LodestoneError):
    """A setting is missing or wrong."""


class SourceError(LodestoneError):
    """A source cannot be read."""


class StoreError(LodestoneError):
    """The corpus store refuses an operation."""


class ProviderError(LodestoneError):
    """A model provider failed."""


def one_line(error: BaseException, secrets: tuple[str, ...] = (), limit: int = 500) -> str:
    """An error's text on one line, secrets masked, cut at the limit; the class name if it has no text."""
    text = " ".join(str(error).split())
    for s in secrets:
        if s:
            text = text.replace(s, "<redacted>")
    return text[:limit] or type(error).__name__
