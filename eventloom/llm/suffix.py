"""Suffix-array dedup of byte strings by hash-compared suffix sort.

windows.py brings together the spans whose anchors are estimated to repeat. Within an anchor the texts to its right, and those
to its left read backwards, are sorted by mergesort. A comparison finds the longest common extension by binary search over
prefix polynomial hashes, in O(log length), then looks at one byte. Neighbours in the sorted order are then compared byte by
byte: a hash collision would show, and that bucket is sorted again by its bytes. Two windows of an anchor are equal if they
fall in the same class of right extensions and the same class of left ones, both read off the common extensions of neighbours.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import BYTE_VALUES, prefix_sums, range_hash
from .windows import Plan, Spans, decided, marked


class Suffixes:
    """Texts read from pos[i] over size[i] bytes, to the right (step 1) or to the left (step -1)."""

    def __init__(self, body: np.ndarray, pos: np.ndarray, size: np.ndarray, step: int):
        self.body, self.pos, self.size, self.step = body, pos, size, step
        self.sums = prefix_sums(BYTE_VALUES[0][body], 0)

    def byte(self, i: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th byte of suffix i."""
        at = self.pos[i] + k if self.step > 0 else self.pos[i] - 1 - k
        return self.body[np.clip(at, 0, len(self.body) - 1)]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The longest common extension, by binary search over hashes."""
        x, y = self.pos[i], self.pos[j]
        low, high = np.zeros(len(i), np.int64), np.minimum(self.size[i], self.size[j])
        while (low < high).any():
            mid = (low + high + 1) >> 1
            if self.step > 0:
                same = range_hash(self.sums, 0, x, x + mid) == range_hash(self.sums, 0, y, y + mid)
            else:
                same = range_hash(self.sums, 0, x - mid, x) == range_hash(self.sums, 0, y - mid, y)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def compare(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Below, at or above zero as suffix i comes before, with or after suffix j; a prefix comes first."""
        k = self.common(i, j)
        a, b = self.size[i], self.size[j]
        over = k == np.minimum(a, b)
        return np.where(over, a - b, self.byte(i, k).astype(np.int64) - self.byte(j, k))

    def text(self, i: int) -> bytes:
        p, n = int(self.pos[i]), int(self.size[i])
        return self.body[p : p + n].tobytes() if self.step > 0 else self.body[p - n : p].tobytes()[::-1]


def merge_sort(first: np.ndarray, size: np.ndarray, compare) -> np.ndarray:
    """Stable mergesort of many groups at once. first[i], size[i]: the group of slot i, in slots. compare(i, j) takes arrays.
    In each round every item finds its rank in the neighbouring run by binary search."""
    order, slot, width = np.arange(len(first)), np.arange(len(first)) - first, 1
    while len(size) and width < size.max():
        act = np.flatnonzero(size > width)
        run = slot[act] // width
        begin = first[act] + (run ^ 1) * width
        low, high = begin.copy(), np.maximum(begin, np.minimum(begin + width, first[act] + size[act]))
        mine, is_left = order[act], run % 2 == 0
        while len(todo := np.flatnonzero(low < high)):
            mid = (low[todo] + high[todo]) >> 1
            c = compare(order[mid], mine[todo])
            past = np.where(is_left[todo], c < 0, c <= 0)
            low[todo], high[todo] = np.where(past, mid + 1, low[todo]), np.where(past, high[todo], mid)
        merged = order.copy()
        merged[first[act] + run // 2 * 2 * width + slot[act] - run * width + low - begin] = mine
        order, width = merged, width * 2
    return order


def sorted_suffixes(s: Suffixes, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): suffixes sorted within runs of equal `group`, and the common extension of each with the one before it,
    -1 at a group's first. Checked byte by byte."""
    n = len(group)
    begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.append(begin, n))
    order = merge_sort(np.repeat(begin, size), np.repeat(size, size), s.compare)
    inner = np.ones(n, bool)
    inner[begin] = False
    at = np.flatnonzero(inner)
    i, j = order[at - 1], order[at]
    k = s.common(i, j)
    step = np.concatenate(([0], np.cumsum(k)[:-1])) if len(k) else k
    offset = np.arange(int(k.sum())) - np.repeat(step, k)
    same = (s.byte(np.repeat(i, k), offset) == s.byte(np.repeat(j, k), offset)).all()
    ends = k == s.size[i]
    ordered = (ends | ((k < s.size[j]) & (s.byte(i, k) < s.byte(j, k)))).all()
    common = np.full(n, -1, np.int64)
    if same and ordered:
        common[at] = k
        return order, common
    for b, m in zip(begin.tolist(), size.tolist(), strict=True):
        own = sorted(range(b, b + m), key=s.text)
        order[b : b + m] = own
        for q in range(1, m):
            x, y = s.text(own[q - 1]), s.text(own[q])
            common[b + q] = next((t for t, (u, v) in enumerate(zip(x, y, strict=False)) if u != v), min(len(x), len(y)))
    return order, common


def _resolve(s: Spans, length: int) -> pa.RecordBatch:
    def flags_of(d: Spans, width: int) -> np.ndarray:
        pos = d.at[:-1] + d.left
        classes = []
        for step, size in ((1, d.at[1:] - pos), (-1, d.left)):
            order, common = sorted_suffixes(Suffixes(d.body, pos, size, step), d.anchor)
            classes.append((order, common))

        def class_at(side: int, depth: int) -> np.ndarray:
            order, common = classes[side]
            out = np.empty(len(order), np.int64)
            out[order] = np.cumsum(common < depth)
            return out

        flags = np.zeros((len(d.n), width), bool)
        by_doc = np.argsort(d.doc, kind="stable")
        for o in range(int(d.left.max()) + 1):
            j = d.left - o  # the window that has its anchor at byte o
            rows = by_doc[((j >= 0) & (j < d.n))[by_doc]]
            if len(rows):
                key = class_at(0, length - o)[rows] * (len(d.n) + 1) + class_at(1, o)[rows]
                _, first, of = np.unique(key, return_index=True, return_inverse=True)
                flags[rows, j[rows]] = d.doc[rows] > d.doc[rows[first]][of]
        return flags

    return decided(s, length, flags_of)


def dedup(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", window: int = 50, gram: int | None = None, cell_bits: int = 28, hot: int = 16384) -> DataFrame:
    """docs with `kept` (binary: the bytes left), n_symbols (bytes), n_removed and n_spans (maximal removed runs).

    A byte of the UTF-8 text is removed if a string of `window` bytes that covers it also starts in a document with a smaller
    doc_id. Strings are judged on the input and never cross documents. What is left may cut a character, hence binary.

    Defined cases: a null text is empty; texts shorter than a window lose nothing; a null doc_id ranks last, and null ids lose
    nothing to each other; rows that share a doc_id lose nothing to each other; an empty table gives an empty result; other
    columns pass through, those named as the new ones give way.
    """
    gram = gram or max(1, window // 3)
    return marked(docs, Plan("bytes", window, gram, cell_bits, hot), _resolve, text=text, doc_id=doc_id)
