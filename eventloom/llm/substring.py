"""Substring dedup behind a count-min prefilter: see windows.py for the passes.

The merged sketches overestimate how often each window occurs; the second pass groups only windows estimated repeated, by
128-bit hashes, and compares the words of each with those of its group's first. No repeated window is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import SPACE_TABLE, mixed, prefix_sums, ragged, range_hash, word_hashes, words_of
from .windows import Plan, Spans, decided, equal_bytes, marked


def _same(body: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray, rep: np.ndarray, own: np.ndarray, length: int) -> bool:
    """Whether the windows (words at[i]:at[i] + length of span own[i]) read as windows rep. Where the windows before both were
    compared too, only the last word is left to compare."""
    last = at + length - 1
    size = end[last] - start[at]
    on = np.concatenate(([False], (own[1:] == own[:-1]) & (own[rep[1:]] == own[rep[:-1]]) & (rep[1:] == rep[:-1] + 1)))
    one = np.where(on, start[last], start[at])
    two = np.where(on, start[last[rep]], start[at[rep]])
    return bool((size == size[rep]).all()) and equal_bytes(body, one, two, end[last] - one)


def _resolve(s: Spans, length: int) -> pa.RecordBatch:
    def flags_of(d: Spans, width: int) -> np.ndarray:
        start, end, row = words_of(d.body, d.at, SPACE_TABLE)
        codes = word_hashes(d.body, start, end)
        first = np.searchsorted(row, np.arange(len(d.n)))
        at = ragged(first, d.n)
        one, two = (mixed(range_hash(prefix_sums(codes, k), k, at, at + length)) for k in (0, 1))
        own = np.repeat(np.arange(len(d.n)), d.n)
        order = np.lexsort((d.doc[own], two, one))
        begin = np.concatenate(([True], (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)))
        rep = np.empty(len(order), np.int64)
        rep[order] = order[np.flatnonzero(begin)][np.cumsum(begin) - 1]
        least = d.doc[own][rep]
        if not _same(d.body, start, end, at, rep, own, length):  # a hash collision: by their bytes then
            smallest: dict[bytes, int] = {}
            texts = [d.body[b:e].tobytes() for b, e in zip(start[at], end[at + length - 1], strict=True)]
            for t, doc in zip(texts, d.doc[own].tolist(), strict=True):
                smallest[t] = min(doc, smallest.get(t, doc))
            least = np.array([smallest[t] for t in texts], np.int64)
        flags = np.zeros((len(d.n), width), bool)
        flags[own, at - first[own]] = d.doc[own] > least
        return flags

    return decided(s, length, flags_of)


def dedup(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", window: int = 50, gram: int | None = None, cell_bits: int = 28, hot: int = 4096) -> DataFrame:
    """docs with `kept` (the words left, joined by one space), n_symbols (words), n_removed and n_spans.

    A word is removed if a window of `window` words that covers it also starts in a document with a smaller doc_id. Windows are
    judged on the input. Words are maximal runs without ASCII white space, unchanged.

    Defined cases: a null or blank text has no words and is kept empty; texts shorter than a window lose nothing; a null doc_id
    ranks last, and null ids lose nothing to each other; rows that share a doc_id lose nothing to each other; an empty table
    gives an empty result; other columns pass through, those named as the new ones give way.
    """
    gram = gram or max(1, window // 3)
    return marked(docs, Plan("words", window, gram, cell_bits, hot, piece=2048), _resolve, text=text, doc_id=doc_id)
