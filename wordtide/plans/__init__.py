"""The registered queries: importing this package fills ``catalog.QUERIES`` and ``catalog.SQL``."""

from . import catalog, extended, scale

__all__ = ["catalog", "extended", "scale"]
