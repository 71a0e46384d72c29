"""Substring deduplication by sliding spans of sentences.

From every sentence on, and up to every sentence, the shortest run of at least SPAN consecutive
sentences with LEAST_WORDS words is hashed, so that runs cover a passage from its first whole
sentence to its last; runs that several documents have are found by one join over all documents,
and the sentences that any run but the first covers go. The first is that of the smallest doc_id, and
there the earliest place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crowded_ids, ids_and_texts, in_parts, written

#: Sentences and words that a run has at least.
SPAN, LEAST_WORDS = 3, 20
#: A sentence of more words is cut after each word whose hash is the least of the NEAR words before and after it (and after each EQUAL equal ones): alike wherever it stands.
LONGEST, NEAR, EQUAL = 12, 3, 8

_WORD = re.compile(r"\S+\s*")
_END = re.compile(r"[.!?…。！？]+[\"'”’)\]]*(?=\s)|\n")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass
class Spans:
    """A text's sentences as ends in characters, and its runs in order of place: first sentence, sentence after the last, and hash."""

    ends: np.ndarray
    first: np.ndarray
    after: np.ndarray
    hashes: np.ndarray


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def spans(text: str) -> Spans:
    """Letter case and white space don't count for a run's hash, which is a polynomial in the hashes of its words."""
    whole = _WORD.findall(text)
    n = len(whole)
    none = np.empty(0, np.int64)
    if not n:
        return Spans(none, none, none, none)
    keys = np.fromiter(map(xxhash.xxh3_64_intdigest, text.lower().split(), repeat(0)), np.uint64, n)
    ends = np.cumsum(np.fromiter(map(len, whole), np.int64, n))
    ends += len(text) - ends[-1]  # white space before the first word
    closes = np.zeros(n, bool)
    closes[-1] = True
    marks = np.fromiter((m.start() for m in _END.finditer(text)), np.int64)
    at = np.searchsorted(ends, marks, side="right")
    closes[at[at < n]] = True
    # words of sentences that are too long are cut at local minima
    last = np.flatnonzero(closes)
    sizes = np.diff(last, prepend=-1)
    long = np.repeat(sizes > LONGEST, sizes)
    if long.any():
        least = np.ones(n, bool)
        for step in range(1, NEAR + 1):
            least[step:] &= keys[step:] <= keys[:-step]
            least[:-step] &= keys[:-step] < keys[step:]
        new = np.ones(n, bool)
        new[1:] = keys[1:] != keys[:-1]
        run = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
        closes |= long & (least | (run % EQUAL == EQUAL - 1))
        last = np.flatnonzero(closes)
    starts = np.concatenate([[0], last[:-1] + 1])  # first word of each sentence
    bounds = np.append(starts, n)
    # a run ends with the first sentence by which it has enough words and sentences
    first = np.arange(len(starts))
    after = np.maximum(np.searchsorted(bounds, starts + LEAST_WORDS), first + SPAN)
    first = first[after <= len(starts)]
    after = after[: len(first)]
    # and begins with the last sentence from which it has: another run where its last sentence isn't needed from there on
    end = np.arange(SPAN, len(bounds))
    begin = np.minimum(np.searchsorted(bounds, bounds[end] - LEAST_WORDS, side="right") - 1, end - SPAN)
    end, begin = end[begin >= 0], begin[begin >= 0]
    new = after[begin] != end
    first, after = np.concatenate([first, begin[new]]), np.concatenate([after, end[new]])
    in_order = np.lexsort((after, first))
    first, after = first[in_order], after[in_order]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(keys * _powers(_BASE, n), dtype=np.uint64)])
    hashed = (sums[bounds[after]] - sums[starts[first]]) * _powers(_INVERSE, n)[starts[first]]
    hashed = (hashed ^ (hashed >> np.uint64(29))) * _MIX
    return Spans(ends[last], first, after, hashed.view(np.int64))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_removed) of every row: text without the sentences that a repeated run covers, and how many these are.

    Rows that share a doc_id count as one document and each keeps what is first there; a null
    doc_id is before all others, as one document with the least id that there can be. Null and empty texts are empty. What remains is unchanged, its
    white space included; a document whose every sentence repeats keeps its row with an empty text.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts, hashes, again = [], [], [], []
            for doc_id, part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found, n = np.unique(spans(text.as_py()).hashes, return_counts=True)
                ids.append(np.full(len(found), doc_id, np.int64))
                parts.append(np.full(len(found), part, np.int32))
                hashes.append(found)
                again.append(n > 1)
            if ids:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in (ids, parts, hashes, again)], names=["doc_id", "part", "h", "again"])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, none, text, inner, foreign in zip(*(c.to_pylist() for c in batch.columns)):
                removed = 0
                if inner or foreign:
                    found = spans(text)
                    repeated = np.isin(found.hashes, np.array(foreign or [], np.int64))
                    earlier = np.ones(len(found.hashes), bool)
                    earlier[np.unique(found.hashes, return_index=True)[1]] = False
                    gone = np.zeros(len(found.ends) + 1, np.int64)
                    hit = repeated | earlier
                    np.add.at(gone, found.first[hit], 1)
                    np.add.at(gone, found.after[hit], -1)
                    keep = np.cumsum(gone)[:-1] == 0
                    removed = int((~keep).sum())
                    begins = np.concatenate([[0], found.ends[:-1]])
                    text = "".join(text[a:b] for a, b in zip(begins[keep].tolist(), found.ends[keep].tolist())) if removed else text
                out.append((None if none else doc_id, text, removed))
            yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64()))], names=["doc_id", "text", "n_removed"])

    texts = ids_and_texts(docs)
    texts = in_parts(texts, crowded_ids(texts))
    runs = written(texts.select("doc_id", "part", "text").mapInArrow(emit, "doc_id long, part int, h long, again boolean"), "runs")
    shared = runs.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max("again").alias("within")).where("first < last or within").select("h", "first")
    # what a row holds again: of its own runs, or of those that an earlier document has; bounded by the text of one part of an id
    later = runs.join(shared, "h").groupBy("doc_id", "part").agg(F.max("again").alias("inner"), F.collect_set(F.when(F.col("doc_id") > F.col("first"), F.col("h"))).alias("foreign"))
    return texts.join(later, ["doc_id", "part"], "left").select("doc_id", "none", "text", "inner", "foreign").mapInArrow(clean, "doc_id long, text string, n_removed long")
