"""Imports every module of this subpackage that registers queries."""

from callweave.llm import queries_calls, queries_documents, queries_transcripts  # noqa: F401
from callweave.llm.registry import QUERIES, SQL  # noqa: F401
