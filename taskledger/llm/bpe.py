"""BPE encoding with reuse of content-defined chunks, and decoding.

A rolling hash over bytes cuts texts where their content says so, so that passages which documents
share give the same chunks wherever they stand. Chunks that occur more than once are encoded once,
in the document of smallest doc_id that has them, and joined to the others; the rest of a text is
encoded in place. Cuts move on to the next ASCII white space, which no pre-token of these
tokenizers crosses, so that encodings can be put end to end. Where none is near, a cut stands
inside a run; such joins are repaired by re-encoding from the last pre-token before the cut over
a growing window until its pre-tokens agree with those of the next chunk.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, chain, groupby, pairwise

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import crowded_ids, cut_lineage, ids_and_texts, in_parts, in_slices, join_salted

#: Mean bytes of a chunk, as a power of two; bytes that the hash sees; how far a cut moves to white space.
CHUNK_BITS, SEEN, REACH = 9, 8, 256
#: Words whose encodings a Python worker keeps before it starts anew, and their bytes.
MAX_WORDS, MAX_HELD = 400_000, 50_000_000
#: Words that are encoded as one text, and bytes of texts whose words are looked up together.
WORDS_AT_ONCE, BYTES_AT_ONCE = 500, 1 << 20
_MULTIPLIER, _CUT_BELOW = np.uint64(0x9E3779B97F4A7C15), np.uint64(1 << 64 - CHUNK_BITS)
_SPACES = b" \t\n\r\x0b\x0c"
_SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")
#: Steps of a tokenizer whose pre-tokens in words of Latin-1 are told without it: there NFC changes nothing.
_CATEGORIES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": _CATEGORIES}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_LATIN = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA1, 0x100))]
_OF_CATEGORY = {k: re.escape("".join(c for c in _LATIN if unicodedata.category(c)[0] == k)) for k in "LN"}
_LATIN_WORD = re.compile("[" + re.escape("".join(_LATIN)) + "]+")
_LATIN_TOKENS = re.compile(_CATEGORIES.replace(r"\p{L}", _OF_CATEGORY["L"]).replace(r"\p{N}", _OF_CATEGORY["N"]))


def chunk_cuts(text: bytes) -> list[int]:
    """Places where the text is cut, rising, without its ends. Equal surroundings are cut alike."""
    cuts: list[int] = []
    for at in range(0, len(text), 1 << 20):  # a megabyte at a time, each with the bytes around it
        low, high = max(0, at - SEEN), min(len(text), at + (1 << 20))
        if high - low <= SEEN:
            continue
        seen = np.ndarray(high - low - SEEN + 1, "<u8", text, low, (1,))  # SEEN bytes from each place on, not copied
        for place in np.flatnonzero(seen * _MULTIPLIER < _CUT_BELOW).tolist():
            p = low + place + SEEN
            if space := _SPACE.search(text, p, p + REACH):
                cuts.append(space.start())
            elif p + REACH < len(text) and _can_cut(text, p):
                cuts.append(p)
    return sorted({c for c in cuts if 0 < c < len(text)})


_SPACE_BYTES = [bytes([b]) for b in _SPACES]


def _can_cut(text: bytes, p: int) -> bool:
    """Whether no character, composition or special token is cut: the next character is one that never joins the one before."""
    if text[p] & 0xC0 == 0x80 or b"<|" in text[max(0, p - 32) : p + 2] or b"|>" in text[p : p + 32]:
        return False
    char = text[p : p + 4].decode(errors="ignore")[:1]
    return bool(char) and (ord(char) < 0x300 or 0x3400 <= ord(char) <= 0x9FFF or 0xAC00 <= ord(char) <= 0xD7A3)


def pieces(text: bytes, cuts: list[int]) -> list[bytes]:
    return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]


def runs(chunks: list[bytes], encoded: list[bytes | None]) -> tuple[list[bytes], list[bytes | None]]:
    """Both, but that chunks which stand together and aren't encoded yet are one."""
    texts, ids = [], []
    for none, group in groupby(zip(chunks, encoded), lambda pair: pair[1] is None):
        some, known = zip(*group)
        texts += [b"".join(some)] if none else some
        ids += [None] if none else known
    return texts, ids


def chunk_key(chunk: bytes) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(chunk)
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


class Codec:
    """Encodes and decodes as the tokenizers library does, with a store of words' encodings. Other kinds of tokenizers, such as byte-level ones, are refused."""

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        size = self.library.get_vocab_size()
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.tokens = [self.library.id_to_token(i) or "" for i in range(size)]
        self.raw_tokens = [t.encode() for t in self.tokens]
        self.digits = [b"%d" % i for i in range(size)]
        self.coded = [self._pack([i]) for i in range(size)]
        self.known: dict[bytes, bytes] = {}
        self.held = 0
        alone = [self.library.encode(w, add_special_tokens=False).ids for w in ("One", "two.")]
        both = self.library.encode("One \n two.", add_special_tokens=False).ids
        if both != sum(alone, []) or self.library.decode(both, skip_special_tokens=False) != self.decode(both):
            raise ValueError(f"{path}: white space must end pre-tokens and be dropped, and decoding must join tokens with spaces")
        spec = json.loads(self.library.to_str())
        steps = (spec["normalizer"], spec["pre_tokenizer"], spec["model"]["type"], spec["model"].get("dropout"))
        self.latin = steps == (_NORMALIZER, {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]}, "BPE", None) and all(t["content"].startswith("<|") for t in spec["added_tokens"])
        self.letters = {ord(c): self.library.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in _LATIN} if self.latin else {}

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def learn(self, words: set[bytes]) -> None:
        """Encodes the words that aren't known, many in one text: white space keeps them apart."""
        new = [w for w in words if w not in self.known]
        if new and (len(self.known) > MAX_WORDS or self.held > MAX_HELD):
            self.known.clear()
            self.held = 0
            new = list(words)
        if self.latin:
            new = [w for w in new if not self._learn_latin(w)]
        for at in range(0, len(new), WORDS_AT_ONCE):
            raw = new[at : at + WORDS_AT_ONCE]
            text = b" ".join(raw).decode()
            found = self.library.encode(text, add_special_tokens=False)
            packed, size = self._pack(found.ids), self.dtype.itemsize
            token_ends = np.fromiter(chain.from_iterable(found.offsets), np.int64, 2 * len(found.ids))[1::2]
            word_ends = np.fromiter(accumulate((1 + len(w) for w in text.split(" ")), initial=-1), np.int64, len(raw) + 1)
            # a word's tokens are those up to the first one that ends after it
            ends = (np.searchsorted(np.maximum.accumulate(token_ends), word_ends, "right") * size).tolist()
            self.known.update(zip(raw, (packed[a:b] for a, b in pairwise(ends))))
            self.held += sum(map(len, raw)) + len(packed)

    def _learn_latin(self, raw: bytes) -> bool:
        """Encodes a word of Latin-1 from its pre-tokens, which are kept like words, for many words differ in marks and capitals only. False: not such a word."""
        word = raw.decode()
        if b"<|" in raw or not (word.isascii() and word.isprintable() or _LATIN_WORD.fullmatch(word)):
            return False
        parts, tokenize = [], self.library.model.tokenize
        for token in _LATIN_TOKENS.findall(word.lower()):
            key = token.encode()
            ids = self.known.get(key)
            if ids is None:
                found = tokenize(token if token.isascii() else token.translate(self.letters))
                ids = self.known[key] = b"".join([self.coded[t.id] for t in found])
                self.held += len(key) + len(ids)
            parts.append(ids)
        self.known[raw] = ids = b"".join(parts)
        self.held += len(raw) + len(ids)
        return True

    def encode(self, text: bytes) -> bytes:
        """Ids of a text, packed."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, packed. Words are looked up for about a megabyte of texts together."""
        out, at = [], 0
        ends = np.cumsum([0, *map(len, texts)])
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(ends, ends[at] + BYTES_AT_ONCE, "right")) - 1)
            words = [text.split() for text in texts[at:end]]
            found = [list(map(self.known.get, w)) for w in words]
            if new := {w for pair in zip(words, found) for w, ids in zip(*pair) if ids is None}:
                self.learn(new)  # may drop others: what was found is kept here
                found = [[self.known[w] if ids is None else ids for w, ids in zip(*pair)] for pair in zip(words, found)]
            out += [b"".join(ids) for ids in found]
            at = end
        return out

    def unpack(self, packed: bytes) -> np.ndarray:
        return np.frombuffer(packed, self.dtype)

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))

    def joined(self, chunks: list[bytes], encoded: list[bytes | None]) -> bytes:
        """Ids of the whole text of the chunks, of which some are encoded already."""
        out: list[bytes] = []
        i = 0
        chunks, encoded = runs(chunks, encoded)
        while i < len(chunks):
            j, text = i + 1, chunks[i]
            ids = self.encode(text) if encoded[i] is None else encoded[i]
            if j < len(chunks) and text[-1] not in _SPACES and chunks[j][0] not in _SPACES:
                tail = text[max(text.rfind(b) for b in _SPACE_BYTES) + 1 :].decode()
                while j < len(chunks) and text[-1] not in _SPACES and chunks[j][0] not in _SPACES:
                    text = chunks[j]
                    kept, ids, tail = self._repaired(tail, ids, text, encoded[j])
                    out.append(kept)
                    j += 1
            out.append(ids)
            i = j
        return b"".join(out)

    def _starts(self, words: list[int | None]) -> list[int]:
        """Places of the first token of each pre-token."""
        return [k for k, w in enumerate(words) if not k or w is None or w != words[k - 1]]

    def _repaired(self, tail: str, left_ids: bytes, right: bytes, right_ids: bytes | None) -> tuple[bytes, bytes, str]:
        """(ids that stand, ids from there to the end of right, tail) where a pre-token may cross the join.

        tail: the end of the text so far, from the start of one of its pre-tokens on. Pre-tokens are
        found from left to right without looking back: what starts where one starts is encoded as
        if the text began there, and all but the last one before a join stand.
        """
        own = self.library.encode(tail, add_special_tokens=False)
        whole = right.decode()
        if right_ids is None:
            right_ids = self.encode(right)
        if not own.ids:
            return left_ids, right_ids, _last_run(whole)
        k = self._starts(own.word_ids)[-1]
        from_last = tail[own.offsets[k][0] :]
        kept = left_ids[: len(left_ids) - (len(own.ids) - k) * self.dtype.itemsize]
        width = 64
        while True:
            head = whole[:width]
            window = self.library.encode(from_last + head, add_special_tokens=False)
            if width >= len(whole):
                return kept, self._pack(window.ids), _last_run(whole, from_last)
            alone = self.library.encode(head, add_special_tokens=False)
            # starts of pre-tokens that both have, but for the last, which the window's end may cut
            ours = {window.offsets[n][0] - len(from_last): n for n in self._starts(window.word_ids)[:-1]}
            theirs = {alone.offsets[n][0]: n for n in self._starts(alone.word_ids)[:-1]}
            if both := [p for p in theirs if p > 0 and p in ours]:
                p = min(both)
                return kept, self._pack(window.ids[: ours[p]]) + right_ids[theirs[p] * self.dtype.itemsize :], _last_run(whole[p:])
            width *= 2


def _last_run(text: str, before: str = "") -> str:
    """What stands after the last ASCII white space of before and text."""
    at = max(text.rfind(chr(b)) for b in _SPACES)
    return text[at + 1 :] if at >= 0 else before + text


@cache
def codec(path: str) -> Codec:
    """One for each Python worker."""
    return Codec(path)


def shared_encodings(docs: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Two tables: `whole` (doc_id, part, packed, cuts) of every document, cut up and compressed; `known` (doc_id, part, found array of (h1, h2, ids)) of documents with chunks that occur more than once. For part see in_parts(); that of rows without an id is below 0."""

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            rows = []
            for doc_id, part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                raw = text.as_buffer().to_pybytes()
                rows += [(doc_id, part, *key) for key in map(chunk_key, pieces(raw, chunk_cuts(raw)))]
            columns = zip(*rows) if rows else [()] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["doc_id", "part", "h1", "h2"])

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in in_slices(batches):
            packed, cuts = [], []
            for text in batch.column(2):
                raw = text.as_buffer().to_pybytes()
                packed.append(press.compress(raw))
                cuts.append(chunk_cuts(raw))
            yield pa.record_batch([*batch.columns[:2], pa.array(packed, pa.binary()), pa.array(cuts, pa.list_(pa.int32()))], names=["doc_id", "part", "packed", "cuts"])

    def encode_owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in in_slices(batches):
            found: dict[tuple[int, int], bytes] = {}
            for packed, cuts, owned in zip(*(c.to_pylist() for c in batch.columns)):
                wanted = {(k["h1"], k["h2"]) for k in owned or ()}
                for chunk in pieces(zstandard.decompress(packed), cuts) if wanted else ():
                    if (key := chunk_key(chunk)) in wanted:
                        found[key] = chunk
            keys = list(found)
            ids = tool.encode_all(list(found.values()))
            yield pa.record_batch([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(ids, pa.binary())], names=["h1", "h2", "ids"])

    texts = ids_and_texts(docs)
    part = F.when(F.col("none"), -1 - F.col("part")).otherwise(F.col("part")).alias("part")
    texts = in_parts(texts, crowded_ids(texts)).select("doc_id", part, "text")
    whole = texts.mapInArrow(cut_up, "doc_id long, part int, packed binary, cuts array<int>")
    each = cut_lineage(texts.mapInArrow(occurrences, "doc_id long, part int, h1 long, h2 long").groupBy("doc_id", "part", "h1", "h2").agg(F.count("*").alias("n")))
    shared = each.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "part")).alias("owner"), F.count("*").alias("docs")).where("n > 1")
    shared = cut_lineage(shared.select("h1", "h2", "docs", "owner.doc_id", "owner.part"))
    owned = shared.groupBy("doc_id", "part").agg(F.collect_list(F.struct("h1", "h2")).alias("owned"))  # bounded by the text of one part of an id
    # a left join like that of the texts with `known`, so that Spark shuffles `whole` once for both
    once = whole.join(owned, ["doc_id", "part"], "left").select("packed", "cuts", "owned").mapInArrow(encode_owned, "h1 long, h2 long, ids binary")
    once = once.groupBy("h1", "h2").agg(F.first("ids").alias("ids"))  # rows may repeat a doc_id
    known = join_salted(each, once, ["h1", "h2"], shared.select("h1", "h2", F.col("docs").alias("n"))).groupBy("doc_id", "part").agg(F.collect_list(F.struct("h1", "h2", "ids")).alias("found"))
    return whole, known


def encoded_texts(docs: DataFrame, path: str, schema: str, finish) -> DataFrame:
    """What `finish(codec, doc_ids, ids)` makes of each batch: doc_ids an Arrow array, ids a list of arrays."""
    whole, known = shared_encodings(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in in_slices(batches):
            rows = []
            for packed, cuts, found in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                have = {(k["h1"], k["h2"]): k["ids"] for k in found or ()}
                chunks = [c for c in pieces(zstandard.decompress(packed), cuts) if c]
                rows.append(runs(chunks, [have.get(chunk_key(c)) for c in chunks] if have else [None] * len(chunks)))
            new = iter(tool.encode_all([t for texts, ids in rows for t, known in zip(texts, ids) if known is None]))
            whole = [(texts, [next(new) if known is None else known for known in ids]) for texts, ids in rows]
            yield finish(tool, batch.column(0), [tool.unpack(tool.joined(*r)) for r in whole])

    doc_id = F.when(F.col("part") >= 0, F.col("doc_id")).alias("doc_id")
    return whole.join(known, ["doc_id", "part"], "left").select(doc_id, "packed", "cuts", "found").mapInArrow(run, schema)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every row: the whole text's ids without special tokens added; empty and null texts have none."""

    def finish(tool: Codec, doc_ids: pa.Array, ids: list[np.ndarray]) -> pa.RecordBatch:
        values = np.concatenate([np.empty(0, np.int32), *ids]).astype(np.int32)
        ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        return pa.record_batch([doc_ids, pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["doc_id", "ids"])

    return encoded_texts(docs, path, "doc_id long, ids array<int>", finish)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give an empty text, and ids that the vocabulary lacks are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([tool.decode([i for i in ids or () if i is not None and 0 <= i < len(tool.tokens)]) for ids in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, from its ids and from the text that these decode to."""

    def finish(tool: Codec, doc_ids: pa.Array, ids: list[np.ndarray]) -> pa.RecordBatch:
        lists = [x.tolist() for x in ids]
        written = [hashlib.sha256(b" ".join(map(tool.digits.__getitem__, x))).hexdigest() for x in lists]
        decoded = [hashlib.sha256(b" ".join(map(tool.raw_tokens.__getitem__, x))).hexdigest() for x in lists]
        return pa.record_batch([doc_ids, pa.array(list(map(len, lists)), pa.int64()), pa.array(written), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded_texts(docs, path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", finish)
