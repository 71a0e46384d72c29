import math
import random
import zlib

from taskledger.llm import toxicity as T

from .conftest import ODD, WORDS


def corpus(n=400):
    """Documents of which a fifth have a bad word: whole, or a stem with various endings."""
    draw = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        words = draw.choices(WORDS, k=60)
        bad = i % 5 == 0
        if bad:
            words[10] = draw.choice(["clodpole", "vile" + draw.choice(["ness", "st", "an"]), "numpty"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_fold():
    assert T.fold("1D10T! Іdiоt $tupid st@r 5ecret cafÉ") == "idiot! idiot stupid star secret café"
    assert T.fold("zero​width") == "zerowidth" and T.fold("café") == "café"


def test_matches_words_stems_and_exceptions():
    m = T.Lexicon({"clown": 2.0, "vile*": 3.0}, ["clown fish"], (-1.0, 2.0, 0.0)).matcher()
    assert [h[2] for h in m.hits(T.fold("A cl0wn, a clown fish, clowns, vileness and devile"))] == [2.0, 3.0]
    assert m.score("a clown") > m.score("a fine day") == m.score("") == 1 / (1 + 2.718281828459045)
    assert m.score("clown " + "word " * 5_000) < m.score("clown")


def brute_hits(lexicon, folded):
    """Every place of every term, one by one."""
    def places(term, stem):
        for at in range(len(folded)):
            end = at + len(term)
            if folded[at:end] == term and not (at and folded[at - 1].isalnum()) and (stem or not folded[end : end + 1].isalnum()):
                yield at, end

    spared = [p for phrase in lexicon.exceptions for p in places(phrase, False)]
    found = [(a, b, w) for t, w in lexicon.weights.items() for a, b in places(t.rstrip("*"), t.endswith("*"))]
    return sorted(h for h in found if not any(a <= h[0] and h[1] <= b for a, b in spared))


def test_matcher_is_that_of_brute_force():
    draw = random.Random(2)
    words = ["ab", "abc", "abcd", "b", "ba", "cab", "éa", "a1"]
    lexicon = T.Lexicon({"ab": 1.0, "abc*": 2.0, "abc": 3.0, "b*": 0.5, "cab": 4.0, "éa": 1.5}, ["ab b", "b ab", "abcd abcd"])
    matcher = lexicon.matcher()
    for _ in range(300):
        text = T.fold("".join(draw.choice(words) + draw.choice([" ", " ", ", ", "  ", "", "_", "\n"]) for _ in range(draw.randrange(12))))
        assert sorted(matcher.hits(text)) == brute_hits(lexicon, text)


def brute_lexicon(rows, labels):
    """Terms and exceptions by plain loops over all labelled texts."""
    label = {}
    for i, y in labels:
        if i is not None and y in (0, 1) and zlib.crc32(str(i).encode()) % 5:
            label[i] = max(y, label.get(i, 0))
    texts = {}
    for i, t in rows:
        if i in label:
            texts[t or ""] = max(label[i], texts.get(t or "", 0))
    found = {t: T.words(T.fold(t)) for t in texts}
    bad = sum(texts.values())
    good = len(texts) - bad

    def odds(n, b):
        return math.log((b + 0.1) / (bad + 0.2)) - math.log((n - b + 0.1) / (good + 0.2))

    has = {t: set(w) | {x[:k] + "*" for x in w for k in range(4, 10) if k < len(x)} for t, w in found.items()}
    candidates = {}
    for term in set().union(*has.values()):
        n, b = sum(term in h for h in has.values()), sum(term in has[t] for t in texts if texts[t])
        expected = n * bad / len(texts)
        if n >= T.MIN_DOCS and odds(n, b) >= math.log(T.MIN_RATIO) and b - expected >= 4 * math.sqrt(expected + 0.5):
            candidates[term] = odds(n, b)
    chosen, share, open_ = {}, {t: 1.0 for t in texts if texts[t]}, set(candidates)
    blocked = {t: set() for t in share}
    while True:
        worth = {c: sum(s for t, s in share.items() if c in has[t] and c not in blocked[t]) for c in open_}
        best = max(worth, key=lambda c: (round(worth[c] * candidates[c], 9), len(c), c), default=None)
        if best is None or worth[best] < max(0.75 * T.MIN_DOCS, 0.01 * bad):
            break
        chosen[best] = candidates[best]
        same = {c for c in candidates if c.rstrip("*").startswith(best.rstrip("*")) or best.rstrip("*").startswith(c.rstrip("*"))}
        for t in share:
            if best in has[t] and best not in blocked[t]:
                share[t] *= T.DISCOUNT
            blocked[t] |= same
        open_ -= same
    known = lambda w: w in chosen or any(w[:k] + "*" in chosen for k in range(4, 10))
    around = {t: {f"{a} {b}" for a, b in zip(w, w[1:]) if known(a) or known(b)} for t, w in found.items()}
    mild = []
    for phrase in set().union(*around.values()):
        n, b = sum(phrase in a for a in around.values()), sum(phrase in around[t] for t in texts if texts[t])
        if n >= T.MIN_DOCS and odds(n, b) <= 0:
            mild.append(phrase)
    return chosen, sorted(mild)


def test_learner_is_that_of_brute_force(spark, docs):
    """With repeated rows, ids labelled both ways, null ids, ties between terms, and a mild use of a bad word."""
    rows, labels = corpus()
    rows += [(1_000 + i, f"the clown fish swims {WORDS[i % 20]}") for i in range(7)] + [(2_000 + i, f"{WORDS[i % 11]} clown {WORDS[i % 20]} {WORDS[i % 7]}") for i in range(60)] + rows[:3] + [(None, "a clown"), (3_000, None)]
    labels += [(1_000 + i, 0) for i in range(7)] + [(2_000 + i, 1) for i in range(60)] + [(6, 1), (None, 1), (3_000, 0), (7, None)]
    lexicon = T.learn_lexicon(docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    chosen, mild = brute_lexicon(rows, labels)
    assert lexicon.weights.keys() == chosen.keys() and "clown" in chosen and lexicon.exceptions == mild and "clown fish" in mild
    assert all(math.isclose(lexicon.weights[t], w) for t, w in chosen.items())


def test_held_out_accuracy(spark, docs):
    rows, labels = corpus()
    got = T.toxicity(docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    truth = dict(labels)
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_labels_held_out_are_not_learned(spark, docs):
    rows, labels = corpus()
    table = lambda flip: spark.createDataFrame([(i, 1 - y if flip and zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels], "doc_id long, toxic int")
    assert T.learn_lexicon(docs(rows), table(False)) == T.learn_lexicon(docs(rows), table(True))


def test_odd_rows_and_no_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = T.toxicity(docs(ODD), none).collect()
    assert len(got) == len(ODD) and {r.predicted for r in got} == {0}
    assert T.toxicity(docs([]), none).count() == 0
    kept = T.drop_toxic(docs([*ODD, (50, "you clown")]), T.Lexicon({"clown": 9.0}, [], (-2.0, 5.0, 0.0)))
    assert kept.count() == len(ODD) and kept.columns == docs([]).columns


def test_very_long_texts_and_ties(spark, docs):
    """A whole text counts, however long; texts of equal content score alike, also at the threshold."""
    lexicon = T.Lexicon({"clown": 9.0}, [], (0.0, 5.0, 0.0))
    long = "word " * 200_000
    got = {r.doc_id: r.score for r in T.score_documents(docs([(1, long), (2, long + "clown"), (3, "fine"), (4, "fine"), (5, "clown " * 100_000)]), lexicon).collect()}
    assert got[1] == got[3] == got[4] == 0.5 < got[2] < got[5]
    assert T.drop_toxic(docs([(3, "fine"), (4, "fine")]), lexicon).count() == 0  # at the threshold is rejected
