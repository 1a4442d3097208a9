"""Named queries over the given tables, each with its SQL twin where one exists."""

from airloom.catalog import (  # noqa: F401
    alerts, charts, distributions, drift, ingest, landing, rows, statistics, streams, validation,
)
from airloom.catalog.base import CATALOG  # noqa: F401
