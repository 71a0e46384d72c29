import hashlib
import math
import random
import re
from collections import Counter

import duckdb

from taskledger.llm import secrets as S
from taskledger.llm.queries import ORACLE_SQL

from .conftest import ODD

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16])


def entropy(text):
    out = []
    for m in re.finditer(S.CANDIDATE, text):
        c = m[0]
        if not (re.search("[0-9]", c) and re.search("[A-Za-z]", c)) or any(re.fullmatch(p, c) for p in S.ALLOW):
            continue
        bound = next(b for p, b in S.CLASSES if re.fullmatch(p, c))
        n = S.WINDOW
        high = [i for i in range(len(c) - n + 1) if -sum(k / n * math.log2(k / n) for k in Counter(c[i : i + n]).values()) >= bound - 1e-9 / n]
        if high and not any(s < m.start() + high[-1] + n and m.start() + high[0] < e for s, _, e in base(text)):
            out.append((m.start() + high[0], 3, m.start() + high[-1] + n))
    return out


def written(spans):
    return ",".join(f"{S.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def texts():
    draw = random.Random(2)
    key = lambda n, chars: "".join(draw.choices(chars, k=n))
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    return [
        f"é\U0001f600 Password = '{key(20, alnum)}' and API_KEY:{key(12, alnum)} apikey={key(11, alnum)}", "secret:token:abcdefghijkl token=secret=abcdefghijkl", f"AKIA{key(16, 'ABCDEFGH0123')} xAKIAAKIA{key(9, 'XYZ9')}",
        f"{key(40, '0123456789abcdef')} {key(15, '0123456789abcdef')}g 123e4567-e89b-12d3-a456-426614174000", f"see {key(44, alnum)} and {key(30, alnum + '+/')}== here", "aaaaaaaaaaaaaaaaaaaa1aaaaaaaaaaaaaaaa " + "word-and-word-and-another-word-2024",
        f"{key(60, alnum)}AKIA{key(16, 'ABCDEFGH0123')}", "PASSWD\"  :  \"" + key(14, alnum) + " " + "ſecret=abcdefghijklmn", "x" * 30 + key(40, alnum) + "x1" * 30, f"{key(200, alnum)}",
    ]


def test_spans_are_those_of_brute_force(docs):
    rows = [*ODD, *enumerate(texts(), 100)]
    got = sorted((r.doc_id or -1, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in S.secret_spans(docs(rows)).collect())
    want = []
    found = Counter()
    for i, t in rows:
        b, e = base(t or ""), entropy(t or "")
        n = Counter(k for _, k, _ in b)
        found.update(k for _, k, _ in b + e)
        want.append((i or -1, n[0], n[1], n[2], hashlib.sha256(written(b).encode()).hexdigest(), written(sorted(b + e))))
    assert got == sorted(want) and min(found[k] for k in range(4)) >= 2


def test_redacted_text(docs):
    rows = [*ODD, *enumerate(texts(), 100)]
    got = {r.doc_id: r for r in S.redact(docs(rows)).collect() if r.doc_id is not None}
    for i, t in rows:
        if i is None:
            continue
        out, at = "", 0
        for s, _, e in sorted(base(t or "") + entropy(t or "")):
            if s >= at:
                out += t[at:s] + S.MASK
            at = max(at, e)
        assert got[i].text == (None if t is None else out + t[at:])
        assert got[i].n_chars == (None if t is None else len(got[i].text))
    assert S.redact(docs([])).columns == docs([]).columns


def test_no_python_in_the_plan(docs):
    plan = S.secret_spans(docs([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan.replace("PythonRDD", "") and "Arrow" not in plan


def test_sql_states_the_same(docs):
    rows = [*ODD, *enumerate(texts(), 100)]
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar)")
    db.executemany("insert into documents values (?, ?)", rows)
    want = db.sql(f"select doc_id, n_assign, n_access, n_hex, base_sha256, spans from ({ORACLE_SQL['op5_secrets']})").fetchall()
    got = [(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in S.secret_spans(docs(rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
