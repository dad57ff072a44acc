"""All registered queries."""

from . import catalogue, event_catalogue, store_catalogue, time_catalogue, wave_catalogue
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "catalogue", "event_catalogue", "store_catalogue", "time_catalogue", "wave_catalogue"]
