"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases and maps homoglyphs, digits and symbols that stand for letters. Terms are
whole folded words, or stems (written with a final *) that any word ending may follow. A hit
inside an exception phrase is not counted. The hits' weights, normalised by the text's length,
give the score through a logistic curve. Lexicon, exceptions and curve are learned from labelled rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, ids_and_texts, in_slices

#: Digits, symbols and letters of other scripts that are written for Latin letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SYMBOLS = {"@": "a", "$": "s", "!": "i", "|": "i"}
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "m", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "γ": "y", "ı": "i", "ſ": "s",
}
#: Code points that are not seen and are dropped: soft hyphen, zero-width characters, word joiner, byte order mark.
INVISIBLE = {0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF}

#: Labelled rows that the model is learned from, at most: those of least hash. Terms and phrases have no bound but what these rows hold.
MAX_TRAIN = 20_000
#: Terms that a task counts before it sends their counts on.
TERMS_HELD = 1 << 17
#: Labelled documents that a term must be in at least, and how much likelier it must be in toxic ones.
MIN_DOCS, MIN_RATIO = 4, 8.0
#: How much less a document counts for the choice of terms with each that it has.
DISCOUNT = 0.6
#: Lengths of stems.
STEMS = range(4, 10)

_WORD = re.compile(r"[^\W_]+")
_SYMBOL = re.compile(r"(?<=\w)[@$!|](?=\w)|(?<!\w)[@$](?=\w)")


class _Fold(dict):
    """Map of code points for str.translate, filled as characters are met."""

    def __missing__(self, code: int) -> str | None:
        char = chr(code)
        plain = char if code < 128 else unicodedata.normalize("NFKC", char).lower()
        to = None if code in INVISIBLE else "".join(DIGITS.get(c) or HOMOGLYPHS.get(c, c) for c in plain)
        self[code] = to
        return to


_FOLD = _Fold()


def fold(text: str) -> str:
    """The text in lower case, composed, with look-alikes mapped to Latin letters.

    Digits are mapped everywhere; a symbol only before a word character and, but for @ and $,
    after one, so that punctuation stays. Accented Latin letters are letters of their own.
    """
    text = _SYMBOL.sub(lambda m: SYMBOLS[m[0]], text.lower())
    return text.translate(_FOLD) if text.isascii() else unicodedata.normalize("NFC", text).translate(_FOLD)


def words(folded: str) -> list[str]:
    return _WORD.findall(folded)


def terms_of(found: list[str]) -> set[str]:
    """Words and stems of a text."""
    one = set(found)
    return one | {f"{w[:n]}*" for w in one for n in STEMS if n < len(w)}


def _outside(found: list[tuple[int, int, float]], spans: list[tuple[int, int]]) -> list[tuple[int, int, float]]:
    """Hits that no span holds whole; both are in order of their ends, and one sweep from the last keeps the least start of the spans that end there or later."""
    kept, at, least = [], len(spans) - 1, math.inf
    for hit in reversed(found):
        while at >= 0 and spans[at][1] >= hit[1]:
            least = min(least, spans[at][0])
            at -= 1
        if least > hit[0]:
            kept.append(hit)
    return kept[::-1]


@dataclass
class Lexicon:
    """Weights by term, exception phrases (folded words joined by one space), and the curve's three numbers."""

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float, float] = (-1.0, 1.0, 0.0)

    def matcher(self) -> "Matcher":
        return Matcher(self)


class Matcher:
    """An Aho-Corasick automaton over terms and exception phrases; built once in each Python worker."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self.automaton = ahocorasick.Automaton()
        by_text: dict[str, list[tuple[bool, float | None]]] = {}
        for term, weight in lexicon.weights.items():
            by_text.setdefault(term.rstrip("*"), []).append((term.endswith("*"), weight))
        for phrase in lexicon.exceptions:
            by_text.setdefault(phrase, []).append((False, None))
        for text, kinds in by_text.items():
            self.automaton.add_word(text, (len(text), kinds))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of each term that stands as a word or begins one, outside exception phrases; ends exclusive."""
        if not len(self.automaton):
            return []
        found, spared = [], []
        for last, (n, kinds) in self.automaton.iter(folded):
            start, end = last + 1 - n, last + 1
            if start and folded[start - 1].isalnum():
                continue
            goes_on = end < len(folded) and folded[end].isalnum()
            for stem, weight in kinds:
                if goes_on and not stem:
                    continue
                if weight is None:
                    spared.append((start, end))
                else:
                    found.append((start, end, weight))
        return _outside(found, spared) if spared else found

    def features(self, text: str) -> tuple[float, float]:
        return self.features_of(fold(text), len(text))

    def features_of(self, folded: str, length: int) -> tuple[float, float]:
        """(weight of hits, the same for each of the square root of a hundred words) of a folded text and the length it had."""
        total = sum(w for _, _, w in self.hits(folded))
        length = max(1.0, length / 6)
        return total, total / math.sqrt(max(length, 25.0) / 100)

    def score(self, text: str) -> float:
        base, slope, bend = self.lexicon.curve
        total, dense = self.features(text)
        x = base + slope * math.log1p(dense) + bend * math.log1p(total)
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def fold_of(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of doc_id as text, modulo folds; fold 0 is held out. A null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def learn_lexicon(docs: DataFrame, labels: DataFrame, label_col: str = "toxic") -> Lexicon:
    """Lexicon, exceptions and curve from labelled rows outside fold 0, MAX_TRAIN at most; equal texts count once.

    Candidates are words and stems far likelier in toxic documents. Of these, terms are chosen
    one by one for the toxic documents that earlier ones are seldom in, so that words that only
    happen to stand in the same documents (or in near copies of one) stay out.
    Without labels of both kinds the lexicon is empty and every score the same.
    A doc_id labelled twice with different labels counts as toxic. Of equally good terms the longest
    is taken, then the last by code points. A text is folded once.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    ids = ids.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold_of(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("label").alias("label"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN)
    rows = ids_and_texts(docs).join(F.broadcast(ids), "doc_id")  # at most MAX_TRAIN rows of two numbers
    rows = rows.groupBy(F.sha2("text", 256)).agg(F.first("text").alias("text"), F.max("label").alias("label")).select("text", "label")

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            texts = batch.column(0).to_pylist()
            yield pa.record_batch([pa.array(map(fold, texts), pa.string()), batch.column(1), pa.array(map(len, texts), pa.int64())], names=["folded", "label", "length"])

    rows = cut_lineage(rows.mapInArrow(folded, "folded string, label int, length long"))
    total = rows.agg(F.sum("label").alias("bad"), F.count("*").alias("n")).first()
    if not 0 < (total.bad or 0) < total.n:
        return Lexicon({})
    bad, good = total.bad, total.n - total.bad
    log_odds = F.log((F.col("bad") + 0.1) / (bad + 0.2)) - F.log((F.col("n") - F.col("bad") + 0.1) / (good + 0.2))

    def counted(terms) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            both = (Counter(), Counter())

            def sent() -> Iterator[pa.RecordBatch]:
                for label, found in enumerate(both):
                    n = pa.array(found.values(), pa.int64())
                    yield pa.record_batch([pa.array(found.keys(), pa.string()), n if label else pa.array([0] * len(found), pa.int64()), n], names=["term", "bad", "n"])
                    found.clear()

            for batch in in_slices(batches):
                for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                    both[label].update(terms(words(text.as_py())))
                    if sum(map(len, both)) > TERMS_HELD:
                        yield from sent()
            yield from sent()

        summed = rows.mapInArrow(run, "term string, bad long, n long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
        return summed.where(F.col("n") >= MIN_DOCS).withColumn("odds", log_odds)

    expected = F.col("n") * bad / total.n
    likely = counted(terms_of).where((F.col("odds") >= math.log(MIN_RATIO)) & (F.col("bad") - expected >= 4 * F.sqrt(expected + 0.5)))
    candidates = {r.term: (int(r.bad), float(r.odds)) for r in likely.collect()}  # of MAX_TRAIN rows

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            yield pa.record_batch([pa.array([[t for t in terms_of(words(x)) if t in candidates] for x in batch.column(0).to_pylist()], pa.list_(pa.string()))], names=["terms"])

    toxic = rows.where("label = 1").mapInArrow(present, "terms array<string>").collect()  # at most MAX_TRAIN rows of candidates
    weights = _cover([set(r.terms) for r in toxic], candidates)
    if not weights:
        return Lexicon({})

    def in_known(word: str) -> bool:
        return word in weights or any(f"{word[:n]}*" in weights for n in STEMS)

    def phrases(found: list[str]) -> set[str]:
        known = set(filter(in_known, set(found)))
        return {f"{a} {b}" for a, b in zip(found, found[1:]) if a in known or b in known} if known else set()

    # phrases around a term that are rarely toxic although the term is
    mild = counted(phrases).where(F.col("odds") <= 0)
    exceptions = [r.term for r in mild.orderBy("term").collect()]  # of MAX_TRAIN rows
    lexicon = Lexicon(weights, exceptions)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.matcher()
        for batch in in_slices(batches):
            both = [matcher.features_of(t.as_py(), n) for t, n in zip(batch.column(0), batch.column(2).to_pylist())]
            yield pa.record_batch([pa.array([round(math.log1p(d), 1) for _, d in both]), pa.array([round(math.log1p(t), 1) for t, _ in both]), batch.column(1)], names=["dense", "total", "label"])

    cells = rows.mapInArrow(bins, "dense double, total double, label int").groupBy("dense", "total", "label").count().collect()  # rounded: a few thousand cells at most
    x = np.array([[1.0, r.dense, r.total] for r in cells])
    y, n = np.array([r.label for r in cells], float), np.array([r["count"] for r in cells], float)
    return Lexicon(weights, exceptions, tuple(_logistic(x, y, n)))


def _cover(toxic: list[set[str]], candidates: dict[str, tuple[int, float]]) -> dict[str, float]:
    """Terms with weights, chosen one by one by the documents they are in, times log-odds; of equals the longest, then the first.

    A document counts DISCOUNT times as much for each chosen term that it has already.
    """
    chosen: dict[str, float] = {}
    left = [(1.0, terms) for terms in toxic if terms]
    while left:  # each term takes a hundredth of the toxic documents, so there are some hundreds at most
        adds: Counter[str] = Counter()
        for share, terms in left:
            for t in terms:
                adds[t] += share
        best = max(adds, key=lambda t: (round(adds[t] * candidates[t][1], 9), len(t), t), default=None)
        if best is None or adds[best] < max(0.75 * MIN_DOCS, 0.01 * len(toxic)):
            break
        chosen[best] = candidates[best][1]
        # a chosen term's other forms that stand for the same words go with it
        left = [(share * DISCOUNT if best in terms else share, {t for t in terms if not _same(t, best)}) for share, terms in left]
    return chosen


def _same(a: str, b: str) -> bool:
    a, b = a.rstrip("*"), b.rstrip("*")
    return a.startswith(b) or b.startswith(a)


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> list[float]:
    """Weighted ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w)), x.T @ (n * (y - p)) - 0.05 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return [float(v) for v in w]


def score_documents(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score) of every row: score from 0 to 1, over the whole text; a null text is empty and scores as one without hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.matcher()
        for batch in in_slices(batches):
            yield pa.record_batch([batch.column(0), pa.array([matcher.score(t.as_py()) for t in batch.column(1)], pa.float64())], names=["doc_id", "score"])

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs; labels, language and source are no inputs of the score."""
    scored = score_documents(docs, learn_lexicon(docs, labels))
    return scored.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5) -> DataFrame:
    """docs, all columns, without the rows whose text scores at or over the threshold."""
    schema = docs.schema
    at = schema.fieldNames().index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.matcher()
        for batch in in_slices(batches):
            keep = [matcher.score(t.as_py() or "") < threshold for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)
