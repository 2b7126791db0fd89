"""Queries for the driver: importing the catalogue registers them."""

from . import content, producers, timeline  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
