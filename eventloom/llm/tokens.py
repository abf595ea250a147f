"""Token counts by a map-side two-tier lookup.

A pre-token here is a maximal run without ASCII white space: a tokenizer whose pre-tokenizer drops white space gives a text the
tokens of its pre-tokens, one after another. The first pass counts pre-tokens in each task and sends only the task's most
frequent ones; the driver encodes the most frequent of all and broadcasts their lengths, a table of at most table_rows entries.
The second pass looks pre-tokens up there, then in a cache of the worker, and encodes what neither has. What is shuffled is each
task's summary, sent_rows pre-tokens with counts at most, to be added up for the table; the pre-tokens of texts never are, and no
result depends on what the table or a cache holds.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, mapped, small_batches, text_arrays

#: Longer pre-tokens are encoded each time, so that table and caches stay small.
LONGEST_KEPT = 64
CACHE_ROWS = 1 << 18
_TOKENIZERS: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _TOKENIZERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _TOKENIZERS[path] = t
    return _TOKENIZERS[path]


def lengths(path: str, texts: list[bytes]) -> list[int]:
    """How many tokens the library gives each text, without begin or end tokens."""
    t = _tokenizer(path)
    return [len(e) for e in t.encode_batch([x.decode() for x in texts], add_special_tokens=False)]


_CACHE: dict[str, dict[bytes, int]] = {}


def _slices(column: pa.Array) -> Iterator[list[bytes]]:
    for _, data, off in text_arrays(column):
        raw = data.tobytes()
        yield [raw[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


def frequent(docs: DataFrame, text: str, table_rows: int, sent_rows: int) -> list[bytes]:
    """The pre-tokens most frequent over all rows, by what each task's sent_rows most frequent ones add up to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for rows in _slices(batch.column(0)):
                for row in rows:
                    seen.update(row.split())
                if len(seen) > 16 * sent_rows:
                    seen = Counter(dict(seen.most_common(8 * sent_rows)))
        top = [(w, n) for w, n in seen.most_common(sent_rows) if len(w) <= LONGEST_KEPT]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], names=["w", "n"])

    small_batches(docs.sparkSession)
    found = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(lean(run), "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(table_rows)
    return [bytes(r.w) for r in found.select("w").collect()]


def counts(docs: DataFrame, tokenizer: str, *, text: str = "text", limit: int = 2048, table_rows: int = 1 << 15, sent_rows: int = 1 << 13) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    tokenizer: path of a `tokenizers` .json file whose pre-tokenizer drops white space, on every executor; tokens in texts that
    spell a special token count as the library's default has it.

    Defined cases: a null text is empty; a text of any length is counted whole; columns of docs named as the new ones give way,
    all others pass through; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    top = frequent(docs, text, table_rows, sent_rows)
    table = spark.sparkContext.broadcast(dict(zip(top, lengths(tokenizer, top), strict=True)))  # at most table_rows entries of LONGEST_KEPT bytes

    def run(texts: Iterator[pa.Array]) -> Iterator[list]:
        known = table.value
        cache = _CACHE.setdefault(tokenizer, {})
        for column in texts:
            n_bytes, n_tokens = [], []
            for rows in _slices(column):
                for row in rows:
                    words = Counter(row.split())
                    total = 0
                    miss = []
                    for w, k in words.items():
                        c = known.get(w)
                        if c is None:
                            c = cache.get(w)
                            if c is None:
                                miss.append(w)
                                continue
                        total += c * k
                    if miss:
                        if len(cache) > CACHE_ROWS:
                            cache.clear()
                        for w, c in zip(miss, lengths(tokenizer, miss), strict=True):
                            total += c * words[w]
                            if len(w) <= LONGEST_KEPT:
                                cache[w] = c
                    n_bytes.append(len(row))
                    n_tokens.append(total)
            found = np.array(n_tokens, np.int64)
            yield [pa.array(n_bytes, pa.int64()), pa.array(found), pa.array(found > limit)]

    return mapped(docs, text, {"n_bytes": "long", "n_tokens": "long", "over_limit": "boolean"}, run)
