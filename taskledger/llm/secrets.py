"""Secret scan with DataFrame functions only.

Base patterns find assignments, access keys and hexadecimal strings. Over candidate strings, a
window slides with incremental counts of its characters; where the window's Shannon entropy
reaches the bound of its character class, the candidate's span is added, unless the allow-list
knows it or a base span overlaps it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns, in the order in which kinds are listed.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy")

#: Candidates of the entropy scan, its window, and bounds in bits for each class of characters, the first that holds the whole candidate.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
CLASSES = (("[0-9]+", 9.0), ("[0-9A-Fa-f-]+", 3.0), ("[A-Z0-9]+=*", 3.6), ("[a-z0-9]+", 3.6), ("[A-Za-z0-9+/_=-]+", 3.8))
#: Candidates that are no secrets: UUIDs, one letter case in words joined by marks, documented examples, runs of the alphabet, data in URLs.
ALLOW = (
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"[A-Za-z][A-Za-z/_=+-]*",
    r"[0-9]([0-9/_=+-]*[0-9])?",
    r".*(?i:example|placeholder|changeme|xxxx|abcdef|012345|123456).*",
    r"[A-Za-z]*([/_=+-]+([A-Za-z]+|[0-9]+))+",
)
MASK = "[SECRET]"

_FIRST, _LAST = 43, 122  # codes of + and z: all characters of candidates
_SPAN = "array<struct<start:int,end:int,kind:int>>"
#: Counts of characters are packed into longs: so many in each, of so many bits (a window's count plus one fits).
_PACKED, _BITS = 12, 5
#: Values of a running sum that one array is built up from, and code points of a block of text.
_BLOCK, _TEXT_BLOCK = 256, 4096


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once for each row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each of some ints, one at least, what op (associative, 0 neutral) makes of all before it.

    Arrays can't be appended to in place. So they are built in blocks of blocks of _BLOCK values each: time grows with their length, not its square.
    """

    def one(xs: Column, start: Column) -> Column:
        empty = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(xs, empty, lambda s, x: F.struct(op(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    def level(n: int, xs: Column) -> Column:
        if not n:
            return one(xs, F.lit(0))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _BLOCK).cast("int")), lambda i: F.slice(xs, i * _BLOCK + 1, F.lit(_BLOCK)))
        return _let(blocks, lambda b: F.flatten(F.zip_with(b, level(n - 1, F.transform(b, lambda x: F.aggregate(x, F.lit(0), lambda a, c: op(a, c)))), one)))

    return level(2, values)


def _located(text: Column, pattern: str, kind: int) -> Column:
    """array<struct(start, end, kind, match)> of the leftmost matches that don't overlap, in code points from 0.

    What stands between matches is split off by the same pattern; lengths of both add up to places.
    """

    def places(both: Column) -> Column:
        m, g = both["m"], both["g"]
        before = _running(F.zip_with(m, g, lambda a, b: F.length(a) + F.length(b)), lambda a, b: a + b)

        def place(match: Column, at: Column) -> Column:
            start = at + match["gap"]
            return F.struct(start.alias("start"), (start + F.length(match["m"])).alias("end"), F.lit(kind).alias("kind"), match["m"].alias("match"))

        return F.zip_with(F.zip_with(m, g, lambda a, b: F.struct(a.alias("m"), F.length(b).alias("gap"))), before, place)

    def found(matches: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
        none = F.array().cast("array<struct<start:int,end:int,kind:int,match:string>>")
        return F.when(F.size(matches) > 0, _let(F.struct(matches.alias("m"), between.alias("g")), places)).otherwise(none)

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"])).cast(_SPAN)


def _bound(candidate: Column) -> Column:
    bound = F.lit(9.0)
    for pattern, bits in reversed(CLASSES):
        bound = F.when(candidate.rlike(f"^(?:{pattern})$"), bits).otherwise(bound)
    return bound


def _dense(candidate: Column, start: Column) -> Column:
    """Span from the first to the last window of high entropy, or null.

    A window's counts, and with them its sum of n*log2(n), follow from those of the one before by
    the character that comes and the one that goes.
    """

    def term(n: Column) -> Column:
        return F.when(n > 1, n * F.log2(F.greatest(n, F.lit(1)))).otherwise(0.0)

    def unit(code: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), code % _PACKED * _BITS)

    def windows(given: Column) -> Column:
        codes, bound = given["codes"], given["bound"]

        def count(state: Column, code: Column) -> Column:
            packed = F.element_at(state["counts"], F.floor(code / _PACKED).cast("int") + 1)
            return F.call_function("shiftright", packed, code % _PACKED * _BITS).bitwiseAND(F.lit((1 << _BITS) - 1).cast("long")).cast("int")

        def slide(state: Column, comes: Column) -> Column:
            i = state["i"] + 1
            goes = F.when(i > WINDOW, F.element_at(codes, i - WINDOW)).otherwise(-1)
            n_in, n_out = count(state, comes), F.when(goes >= 0, count(state, goes)).otherwise(0)
            change = F.when(goes == comes, 0.0).otherwise(term(n_in + 1) - term(n_in) + F.when(goes >= 0, term(n_out - 1) - term(n_out)).otherwise(0.0))
            one = lambda code, k: F.when(F.floor(code / _PACKED) == k, unit(code)).otherwise(F.lit(0).cast("long"))
            counts = F.when(goes == comes, state["counts"]).otherwise(F.transform(state["counts"], lambda n, k: n + one(comes, k) - F.when(goes >= 0, one(goes, k)).otherwise(F.lit(0).cast("long"))))
            total = state["total"] + change
            high = (i >= WINDOW) & (F.lit(WINDOW * math.log2(WINDOW)) - total >= bound * WINDOW - 1e-9)
            first, last = F.when(high & state["first"].isNull(), i - WINDOW).otherwise(state["first"]), F.when(high, i).otherwise(state["last"])
            return F.struct(i.alias("i"), counts.alias("counts"), total.alias("total"), first.alias("first"), last.alias("last"))

        zero = [F.lit(0).alias("i"), F.array_repeat(F.lit(0).cast("long"), (_LAST - _FIRST) // _PACKED + 1).alias("counts"), F.lit(0.0).alias("total")]
        empty = F.struct(*zero, *[F.lit(None).cast("int").alias(c) for c in ("first", "last")])
        span = lambda s: F.when(s["first"].isNotNull(), F.struct((start + s["first"]).alias("start"), (start + s["last"]).alias("end"), F.lit(3).alias("kind")))
        return F.aggregate(codes, empty, slide, span)

    codes = F.transform(F.filter(F.split(candidate, ""), lambda c: c != ""), lambda c: F.ascii(c) - _FIRST)
    return _let(F.struct(codes.alias("codes"), _bound(candidate).alias("bound")), windows)


def _suspicious(candidate: Column) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOW:  # possessive: what a class or group has taken it never has to give back here, and the stack doesn't grow with the text
        possessive = re.sub(r"(?<=[\])])[*+]", r"\g<0>+", pattern)
        allowed = allowed | candidate.rlike(f"^(?:{possessive})$")
    return candidate.rlike("[0-9]") & candidate.rlike("[A-Za-z]") & ~allowed


def _apart(spans: Column, others: Column) -> Column:
    """array<struct(start, kind, end)> of the spans that overlap none of the others: before a span's end, no other that has begun ends after its start."""
    asks = F.transform(spans, lambda s: F.struct(s["end"].alias("at"), F.lit(0).alias("ends"), F.struct(s["start"], s["kind"], s["end"]).alias("span")))
    begun = F.transform(others, lambda b: F.struct(b["start"].alias("at"), b["end"].alias("ends"), F.lit(None).cast("struct<start:int,kind:int,end:int>").alias("span")))

    def free(events: Column) -> Column:
        ends = _running(F.transform(events, lambda e: e["ends"]), F.greatest)
        kept = F.zip_with(events, ends, lambda e, end: F.when(e["span"].isNotNull() & (end <= e["span"]["start"]), e["span"]))
        return F.filter(kept, lambda s: s.isNotNull())

    return _let(spans, lambda given: F.when(F.size(given) > 0, _let(F.array_sort(F.concat(asks, begun)), free)).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>")))


def find_spans(docs: DataFrame, text: Column) -> DataFrame:
    """docs with _base and _spans, arrays of (start, end, kind) in order of start and kind; _spans has the entropy scan's too.

    Null and empty texts have none. Ends are exclusive; places are code points from 0.
    """
    assign = F.filter(_located(F.col("_text"), ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= ASSIGN_VALUE)
    found = docs.withColumn("_text", F.coalesce(text, F.lit(""))).withColumns(
        {"_assign": _plain(assign), "_access": _plain(_located(F.col("_text"), ACCESS, 1)), "_hex": _plain(_located(F.col("_text"), HEX, 2)), "_runs": F.filter(_located(F.col("_text"), CANDIDATE, 3), lambda s: _suspicious(s["match"]))}
    )
    found = found.withColumn("_base", F.array_sort(F.transform(F.concat("_assign", "_access", "_hex"), lambda s: F.struct(s["start"], s["kind"], s["end"]))))
    extra = _apart(F.filter(F.transform("_runs", lambda s: _dense(s["match"], s["start"])), lambda s: s.isNotNull()), F.col("_base"))
    return found.withColumn("_spans", F.when(F.size("_runs") > 0, F.array_sort(F.concat("_base", extra))).otherwise(F.col("_base"))).drop("_runs", "_text")


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row of docs; other columns are ignored."""
    found = find_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), F.col("text"))
    n = {f"n_{k}": F.size(f"_{k}").cast("long") for k in KINDS[:3]}
    return found.select("doc_id", *[v.alias(k) for k, v in n.items()], F.sha2(_written(F.col("_base")).cast("binary"), 256).alias("base_sha256"), _written(F.col("_spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs, all columns, with MASK for every span in text, overlapping ones as one; n_chars, if there, is the new length. A null text stays null."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # apart from the columns made here
    found = find_spans(docs.select(row, F.col("text").alias("text")), F.col("text"))

    def masked(given: Column) -> Column:
        spans, blocks = given["spans"], given["blocks"]

        def between(a: Column, b: Column) -> Column:
            """Code points a to b, from the blocks that hold them."""
            within = F.sequence(F.floor(a / _TEXT_BLOCK).cast("int"), F.floor((b - 1) / _TEXT_BLOCK).cast("int"))
            low = lambda k: F.greatest(a - k * _TEXT_BLOCK, F.lit(0))
            parts = F.transform(within, lambda k: F.substring(F.element_at(blocks, k + 1), low(k) + 1, F.least(b - k * _TEXT_BLOCK, F.lit(_TEXT_BLOCK)) - low(k)))
            return F.when(a < b, F.array_join(parts, "")).otherwise("")

        ends = _running(F.transform(spans, lambda s: s["end"]), F.greatest)
        pieces = F.zip_with(spans, ends, lambda s, end: F.when(s["start"] >= end, F.concat(between(end, s["start"]), F.lit(MASK))).otherwise(""))
        return F.concat(F.array_join(pieces, ""), between(F.array_max(F.transform(spans, lambda s: s["end"])), F.length("text")))

    blocks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{_TEXT_BLOCK}}}"), F.lit(0))
    text = F.when(F.size("_spans") > 0, _let(F.struct(F.col("_spans").alias("spans"), blocks.alias("blocks")), masked)).otherwise(F.col("text"))
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": text}
    out = found.select(*[v.alias(c) for c, v in columns.items()])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
