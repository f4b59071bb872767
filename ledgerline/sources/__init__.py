"""Sources: importing this package registers all connectors."""

from . import connectors, tables  # noqa: F401
