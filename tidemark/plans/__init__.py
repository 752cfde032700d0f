"""The registered queries. The catalogue comes first, as modules of queries use each other's SQL."""

from . import catalog  # noqa: F401
