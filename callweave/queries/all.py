"""Imports every module that registers queries."""

from callweave.queries import distributions, evaluation, files, intervals, models, more, pairing, rest, splits, texts  # noqa: F401
from callweave.queries.registry import QUERIES, SQL  # noqa: F401
