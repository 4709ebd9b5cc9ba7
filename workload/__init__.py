"""The registered queries, one module per family of operators."""

from . import jobs, lexical, scores, structures, text, vectors
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "jobs", "lexical", "scores", "structures", "text", "vectors"]
