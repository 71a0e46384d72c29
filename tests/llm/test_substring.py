import random
from collections import Counter

from taskledger.llm import substring as S

from .conftest import ODD, WORDS


def windows(texts, n=50):
    count = Counter()
    for t in texts:
        w = t.split()
        count.update({tuple(w[i : i + n]) for i in range(len(w) - n + 1)})
    return {k for k, v in count.items() if v > 1}


def prose(draw, n):
    return " ".join(" ".join(draw.choices(WORDS, k=draw.randrange(3, 20))).capitalize() + draw.choice([".", "?", "!\n", ","]) for _ in range(n))


def test_repeated_passages_go_and_the_rest_stays(docs):
    draw = random.Random(7)
    passages = [prose(draw, 12) for _ in range(6)]
    rows = []
    for i in range(80):
        own, part = prose(draw, 10), passages[i % 6]
        at = len(own) // 2
        rows.append((i, own[:at] + " " + part + " " + own[at:] if i % 2 else own))
    got = {r.doc_id: r for r in S.remove_repeats(docs(rows)).collect()}
    assert windows(t for _, t in rows) and not windows(r.text for r in got.values())
    for i, t in rows:
        if i % 2 == 0:
            assert got[i].text == t and got[i].n_removed == 0
        elif i >= 12:
            assert got[i].n_removed > 0 and set(got[i].text.split()) <= set(t.split())
    firsts = {min(i for i, t in rows if p in t) for p in passages if any(p in t for _, t in rows)}
    assert all(got[i].text == dict(rows)[i] for i in firsts)


def test_copies_and_repeats_within(docs):
    draw = random.Random(8)
    text = prose(draw, 20)
    got = {r.doc_id: r for r in S.remove_repeats(docs([(1, text), (2, text), (3, text + "\n" + text), (4, "Of " * 500)])).collect()}
    assert got[1].text == text and got[2].text == "" and not windows(r.text for r in got.values())


def test_odd_rows(docs):
    got = S.remove_repeats(docs(ODD)).collect()
    assert len(got) == len(ODD)
    assert {r.doc_id: r.text for r in got}[5] == "Same text here, in two rows."
    assert S.remove_repeats(docs([])).count() == 0


def test_sentences_make_up_the_text():
    draw = random.Random(9)
    for text in ["", " ", "a", "\n\na. b", prose(draw, 30), "x" * 1_000, "Of " * 100, *((t or "") for _, t in ODD)]:
        found = S.spans(text)
        assert (found.ends[-1] == len(text)) if text.strip() else not len(found.ends)
        for first, after in zip(found.first, found.after):
            begin = found.ends[first - 1] if first else 0
            assert after - first >= S.SPAN and len(text[begin : found.ends[after - 1]].split()) >= S.LEAST_WORDS


def test_a_passage_goes_to_its_last_sentence(docs):
    passage = "One two three four five six seven eight nine ten eleven. A b c d e. F g h i. J k. "
    rows = [(1, "Alpha beta gamma delta. " + passage + "Rest of the first."), (2, "Other words stand here. " + passage + "Second ends so.")]
    got = {r.doc_id: r for r in S.remove_repeats(docs(rows)).collect()}
    assert got[1].text == rows[0][1]
    assert got[2].text == "Other words stand here. Second ends so." and got[2].n_removed == 4


def brute_removed(rows):
    """The rows' texts by plain loops: every run of sentences as a tuple of words, its first document, and what later runs cover."""
    least = -(1 << 63)
    cut = []
    for i, t in rows:
        ends = S.spans(t or "").ends.tolist()
        parts = [(t or "")[a:b] for a, b in zip([0, *ends], ends)]
        sizes = [len(p.split()) for p in parts]
        enough = lambda a, b, n=sizes: b - a >= S.SPAN and sum(n[a:b]) >= S.LEAST_WORDS
        runs = set()
        for at in range(len(parts) + 1):
            runs |= {(at, b) for b in range(at, len(parts) + 1) if enough(at, b) and not enough(at, b - 1)}
            runs |= {(a, at) for a in range(at) if enough(a, at) and not enough(a + 1, at)}
        cut.append((least if i is None else i, parts, [(a, b, tuple("".join(parts[a:b]).lower().split())) for a, b in sorted(runs)]))
    first = {}
    for i, _, runs in cut:
        for *_, words in runs:
            first[words] = min(i, first.get(words, i))
    out = []
    for (i, parts, runs), (doc_id, t) in zip(cut, rows):
        seen, gone = set(), set()
        for a, b, words in runs:
            if words in seen or i > first[words]:
                gone |= set(range(a, b))
            seen.add(words)
        out.append((doc_id, "".join(p for n, p in enumerate(parts) if n not in gone) if gone else t or "", len(gone)))
    return out


def test_rows_are_those_of_brute_force(docs):
    """Passages in many documents and within one, repeated rows, ids that repeat, no ids and the least id that there is, and odd texts."""
    draw = random.Random(11)
    passages = [prose(draw, draw.randrange(4, 9)) for _ in range(5)]
    rows = []
    for i in range(60):
        parts = [prose(draw, draw.randrange(0, 5)), *draw.choices(passages, k=draw.randrange(0, 4)), prose(draw, draw.randrange(0, 4))]
        rows.append((draw.choice([None, -(1 << 63), i, i // 2]), draw.choice([" ", "\n", "  "]).join(parts)))
    rows += [*ODD[:8], *rows[:4]]
    got = [(r.doc_id, r.text, r.n_removed) for r in S.remove_repeats(docs(rows)).collect()]
    assert sorted(got, key=str) == sorted(brute_removed(rows), key=str) and sum(n for *_, n in got) > 200
