"""All registered queries. Importing this package fills the registry."""

from listinglake.catalog import extract, logs, pages, publish, quality, runs, streams  # noqa: F401
from listinglake.catalog.registry import ORACLES, QUERIES  # noqa: F401
