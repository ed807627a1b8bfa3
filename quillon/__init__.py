"""Exact conjunctive full-text search, expressed as Spark DataFrames.

Importing the package pulls in nothing heavy; see :mod:`quillon.engine` for the
facade and :mod:`quillon.operators` for the DataFrame operators.
"""

from quillon.engine import Engine, clear_index, count, index, init, restore_index, save_index, search
from quillon.extension import DocList, InvertedIndex, MemoryDocList, MemoryInvertedIndex
from quillon.functions.text import normalized_tokens, tokenize

__version__ = "0.1.0"
__all__ = [
    "Engine", "init", "index", "save_index", "restore_index", "clear_index", "search", "count",
    "normalized_tokens", "tokenize", "DocList", "MemoryDocList", "InvertedIndex", "MemoryInvertedIndex",
]
