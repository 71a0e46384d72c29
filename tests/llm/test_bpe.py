import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from taskledger.llm import bpe as B

from .conftest import ODD, WORDS

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def brute(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def texts():
    draw = random.Random(3)
    shared = " ".join(draw.choices(WORDS, k=600)) + ". It's they're <|endoftext|> 1234 don't!"
    han = "".join(chr(draw.randrange(0x4E00, 0x9FFF)) for _ in range(6_000))
    runs = "".join(draw.choice(["abc", "é", "'s", "12", "!?", "ß", "'", "日"]) for _ in range(9_000))
    marks = "á" * 3_000 + " " + " x" * 500 + " y" * 500
    return [shared, "intro " + shared + " outro", shared[300:], han, "x" + han, runs, marks, "<|startoftext|>" * 300, "a" * 20_000, "é <|endoftext|≯", "ΣΑΣ İ ŉ ﬁ"]


def test_encodings_are_the_library_s(docs):
    rows = [*ODD, *enumerate(texts(), 100)]
    got = B.encode_documents(docs(rows), PATH)
    assert sorted(((r.doc_id or -1), r.ids) for r in got.collect()) == sorted((i or -1, brute(t)) for i, t in rows)
    back = {r.doc_id: r.text for r in B.decode_documents(got, PATH).collect()}
    for i, t in rows:
        if i is not None:
            assert back[i] == LIBRARY.decode(brute(t), skip_special_tokens=False)


def test_shared_chunks_are_encoded_once(docs):
    body = texts()[0]
    whole, known = B.shared_encodings(docs([(1, body), (2, "Another start. " + body), (3, "alone")]), PATH)
    found = {r.doc_id: {(k.h1, k.h2) for k in r.found} for r in known.collect()}
    assert set(found) == {1, 2} and found[1] == found[2] and len(found[1]) >= 3
    assert whole.count() == 3


class Counting:
    """A tokenizer that notes the words which it is given."""

    def __init__(self, library):
        self.library, self.words = library, []

    def __getattr__(self, name):
        return getattr(self.library, name)

    def encode(self, text, **options):
        self.words += text.split()
        return self.library.encode(text, **options)


def test_words_that_differ_in_marks_and_capitals_are_encoded_by_their_parts(monkeypatch):
    draw = random.Random(5)
    stems = ["".join(draw.choices("abcdeéßü", k=9)) for _ in range(300)]
    words = sorted({draw.choice(["", '"', "("]) + draw.choice([s, s.title(), s.upper() if "ß" not in s else s]) + draw.choice(["", ",", ".", "'s", "...", "$$$"]) for s in stems for _ in range(20)})
    tool = B.Codec(PATH)
    tool.library = counting = Counting(tool.library)
    text = " ".join([*words, "日本", "a<|endoftext|>b"])
    assert tool.unpack(tool.encode(text.encode())).tolist() == brute(text)
    assert sorted(counting.words) == ["a<|endoftext|>b", "日本"]
    tool.latin = False  # as for other tokenizers: all go to the library
    tool.known.clear()
    assert tool.unpack(tool.encode(text.encode())).tolist() == brute(text) and len(counting.words) == len(words) + 4


@pytest.mark.parametrize("at_once", [1, 40, 1 << 20])
def test_odd_words_in_groups_and_a_store_that_is_emptied(monkeypatch, at_once):
    monkeypatch.setattr(B, "BYTES_AT_ONCE", at_once)
    monkeypatch.setattr(B, "MAX_WORDS", 20)
    draw = random.Random(at_once)
    marks = [*"aZéÀßÿµª²½×İŉΣǅ'’<|>$.,1٣_\x00\x1c\x7f\x85\xad\u0301\u200b\u3000日\U0001f600 \t\n", "'s", "'LL", "\xa0", "<|endoftext|>", "<|"]
    some = ["".join(draw.choices(marks, k=draw.randrange(30))) for _ in range(400)] + [""]
    tool = B.Codec(PATH)
    assert [tool.unpack(ids).tolist() for ids in tool.encode_all([t.encode() for t in some])] == [brute(t) for t in some]


@pytest.mark.parametrize("text", texts())
def test_cuts_follow_content_and_joins_are_repaired(text):
    raw = text.encode()
    cuts = B.chunk_cuts(raw)
    chunks = B.pieces(raw, cuts)
    assert b"".join(chunks) == raw
    tool = B.codec(PATH)
    for encoded in ([None] * len(chunks), [tool.encode(c) for c in chunks], [tool.encode(c) if i % 2 else None for i, c in enumerate(chunks)]):
        assert tool.unpack(tool.joined([c for c in chunks if c], [e for c, e in zip(chunks, encoded) if c])).tolist() == brute(text)
    moved = B.chunk_cuts(b"some words before " + raw)
    assert len({c + 18 for c in cuts} - set(moved)) <= 2


def test_digests_and_empty_table(docs):
    assert B.round_trip_digests(docs([]), PATH).count() == 0
    row = B.round_trip_digests(docs([(1, None)]), PATH).first()
    assert row.n_tokens == 0 and row.ids_sha256 == row.decoded_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_decoding_of_odd_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [5, -1, 10_000_000, None, 6]), (None, [5])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in B.decode_documents(rows, PATH).collect()}
    assert got == {1: "", 2: "", 3: LIBRARY.decode([5, 6], skip_special_tokens=False), None: LIBRARY.decode([5], skip_special_tokens=False)}


def test_tokenizers_that_keep_white_space_are_refused():
    B.Codec(PATH)
    with pytest.raises(ValueError):
        B.Codec(public_tokenizers.path("byte_bpe_50k.json"))
