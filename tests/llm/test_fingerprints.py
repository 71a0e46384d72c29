import hashlib
import random

import pytest
import xxhash

from taskledger.llm import fingerprints as P

from .conftest import ODD, WORDS


def test_equal_texts_and_small_edits():
    draw = random.Random(4)
    a = " ".join(draw.choices(WORDS, k=400))
    b = " ".join(draw.choices(WORDS[::-1], k=400))
    assert P.fingerprint(a) == P.fingerprint(a) and P.fingerprint("") == bytes(P.BYTES)
    assert P.likeness(P.fingerprint(a), P.fingerprint(a.replace("omega", "end", 2))) > 0.85
    assert P.edited("abcdefghij", "XY") == "abcdefghXY" and P.edited("abcdefghij", "X") == "abcdefghX" and P.edited("abc", "XYZ") == "abc"


def brute_fingerprint(text):
    """Votes bit by bit: a pair of words votes with the length of its words, MAX_LETTERS at most; a lone word with one."""
    found = text.lower().encode().split()
    pairs = [(b" ".join(p), min(sum(map(len, p)), P.MAX_LETTERS)) for p in zip(found, found[1:])] or [(w, 1) for w in found]
    votes = [0] * P.BITS
    for term, weight in pairs:
        h = int.from_bytes(xxhash.xxh3_128_digest(term, P.SEED), "little")
        for b in range(P.BITS):
            votes[b] += weight if h >> b & 1 else -weight
    return sum(1 << b for b in range(P.BITS) if votes[b] > 0)


def test_votes_bit_by_bit():
    draw = random.Random(3)
    for text in ["", "one", "A b", *(t or "" for _, t in ODD[:11]), *(" ".join(draw.choices(WORDS, k=k)) for k in (2, 3, 50, 300))]:
        assert int.from_bytes(P.fingerprint(text), "little") == brute_fingerprint(text)


def test_next_document_over_all_ranges(docs):
    draw = random.Random(5)
    rows = [*ODD, (200, "one"), (300, "one"), *((i, " ".join(draw.choices(WORDS, k=draw.randrange(1, 80)))) for i in range(100, 160))]
    order = sorted(((i is not None, i or 0, (t or "").encode()) for i, t in rows))
    want = []
    prints = [brute_fingerprint(raw.decode()) for _, _, raw in order]
    for n, (has, i, raw) in enumerate(order):
        text, following = raw.decode(), order[(n + 1) % len(order)][2].decode()
        changed = P.edited(text, following)
        own, new, theirs = map(P.fingerprint, (text, changed, following))
        near = sum((prints[n] ^ v).bit_count() <= P.RADIUS for v in prints) - 1 if has and i % P.EVERY == 0 else None
        want.append((i if has else None, len(text), hashlib.sha256(changed.encode()).hexdigest(), own.hex(), new.hex(), P.likeness(own, new), P.likeness(own, theirs), near))
    assert sorted(map(tuple, P.edited_likeness(docs(rows)).collect()), key=str) == sorted(want, key=str)


def test_one_document_follows_itself(docs):
    assert P.edited_likeness(docs([(7, "abcd efgh")])).first().near_next == 1.0
    assert P.edited_likeness(docs([])).count() == 0


@pytest.mark.parametrize("group", [4096, 3])
def test_block_tables_count_all_within_the_radius(spark, monkeypatch, group):
    """Against all pairs; with a small group every front is crowded and dealt out both ways."""
    monkeypatch.setattr(P, "GROUP", group)
    monkeypatch.setattr(P, "HOT_SHARE", P.HOT_SHARE if group > 3 else 1_000_000)
    monkeypatch.setattr(P, "SAMPLED", P.SAMPLED if group > 3 else 1)
    draw = random.Random(6)
    values = [draw.getrandbits(P.BITS) for _ in range(30)]
    for v in values[:15]:
        for n in (1, 1, 2, 3, 5, 6, 7, 9) * 3:
            values.append(v ^ sum(1 << b for b in draw.sample(range(P.BITS), n)))
    rows = {v: (draw.randrange(1, 5), draw.randrange(2)) for v in values}
    table = spark.createDataFrame([(None, 1, 1), *((bytearray(v.to_bytes(P.BYTES, "little")), *r) for v, r in rows.items())], "fp binary, n long, asked long").repartition(5)
    for radius, blocks in ((P.RADIUS, None), (P.RADIUS, 8), (5, 7), (3, 5)):
        got = {int.from_bytes(r.fp, "little"): r.n_within for r in P.count_within(table, radius, blocks).collect()}
        assert got == {v: sum(n for w, (n, _) in rows.items() if (v ^ w).bit_count() <= radius) for v, (_, asked) in rows.items() if asked}
    assert P.count_within(table.limit(0)).count() == 0
