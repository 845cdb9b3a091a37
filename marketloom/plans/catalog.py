"""Importing this module registers every query of the engine's own operators."""

from . import q_catalogue, q_prices, q_scalars, q_signals, q_streams, q_text  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
