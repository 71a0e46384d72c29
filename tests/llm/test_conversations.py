import hashlib
import zlib
from itertools import groupby, product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from taskledger.llm.conversations import Repair, cheapest, damage, edited, from_every_state, kind_of, put_together
from taskledger.llm.queries import QUERIES

from ..conftest import SF

SCHEMA = "conv_id long, turn long, role string, text string, range int, key string, kind string"
WHITE = " \t\n\x0b\x0c\r"


def damaged(rows):
    for conv, turn, role, text in rows:
        a, b = (" " if x is None else str(x) for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{a}:{b}".encode()) % 20
        if fate:
            text = "" if fate == 1 else "".join(c for c in text if c not in ".!?") if fate == 2 else text
            yield from [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        kept = text.strip(WHITE)
        out.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(rows, found):
    """All audits, shortest lists of edits first: a table over (row, last role given) that keeps the least (cost, audit, turns)."""
    best = {"": (0, "", ())}  # by the letters s, u, a of the last turn given; "" is none

    def insert(best):
        for _ in range(3):
            for last, (cost, audit, turns) in list(best.items()):
                role = "assistant" if last == "u" else "user"
                new = (cost + 2, audit + "I", turns + ((role, ""),))
                best[role[0]] = min(best.get(role[0], new), new)
        return best

    best = insert(best)
    for (_, _, role, text), fault in zip(rows, found):
        new = {}

        def offer(last, made):
            new[last] = min(new.get(last, made), made)

        for last, (cost, audit, turns) in best.items():
            offer(last, (cost + 3, audit + "D", turns))
            if fault in ("blank", "duplicate"):
                continue
            more = fault == "truncated"
            wanted = "assistant" if last == "u" else "user"
            offer(wanted[0], (cost + 2 + more, audit + "R", turns + ((wanted, text),)))
            if role[:1] == wanted[0] or role[:1] == "s" and last == "":
                offer(role[0], (cost + more, audit + "K", turns + ((role, text),)))
        best = insert(new)
    return min(best[x] for x in ("", "a") if x in best)


def expected(rows):
    out = {}
    by = lambda r: (r[0] is not None, r[0] or 0)
    kept = sorted(damaged(rows), key=lambda r: (by(r), r[1] is not None, r[1] or 0, r[2], r[3]))
    found = {k: list(v) for k, v in groupby(kept, key=lambda r: r[0])}
    for conv in {r[0] for r in rows}:
        mine = found.get(conv, [])
        f = faults(mine)
        turns = {r[1] for r in mine} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, turns = brute(mine, f)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
        out[conv] = (gaps, f.count("blank"), f.count("duplicate"), f.count("truncated"), illegal, cost, audit, sha)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(4)


def reports(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def odd_rows():
    words = ["Yes.", "No", "So?", " ", "", None, "x" * 70 + "a.", "x" * 70 + "b.", "Ça va ?\t", "été"]
    roles = ["user", "assistant", "system", None, "tool", "", "User"]
    rows = [(c, t, roles[(c * 7 + t * 3) % 7], words[(c * 3 + t) % 10]) for c in range(60) for t in range(c % 9)]
    rows += [(None, t, "user" if t % 2 else "assistant", f"Text {t % 7}.") for t in range(40)]
    rows += [(70, None, "user", "A."), (70, None, "assistant", "B."), (71, None, None, None)]
    return rows + rows[:25]  # repeated rows


@pytest.mark.parametrize("long,block", [(4096, 512), (0, 4), (5, 3)])
def test_equals_brute_force(spark, long, block):
    rows = odd_rows()
    repair = Repair(damage(frame(spark, rows)), long=long, block=block)
    assert reports(repair.report()) == expected(rows)
    digests = {k: v[-1] for k, v in expected(rows).items()}
    turns = {}
    for r in sorted(repair.turns().collect(), key=lambda r: r.place):
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in turns.items()} == {k: d for k, d in digests.items() if k in turns}
    assert all(digests[k] == hashlib.sha256().hexdigest() for k in digests if k not in turns)


def test_hot_conversation_is_many_ranges(spark):
    rows = [(1, t // 3, ("user", "assistant", "user", "system")[t % 4], f"Text {t % 900}{'.!x'[t % 3]}") for t in range(6000)] + [(c, 0, "user", "Hi.") for c in range(2, 200)]
    repair = Repair(damage(frame(spark, rows)), long=100, block=64)
    found = reports(repair.report())
    want = expected([r for r in rows if r[0] == 1]) | expected([r for r in rows if r[0] != 1])
    assert found == want


def test_empty_table(spark):
    repair = Repair(damage(frame(spark, [])))
    assert repair.report().count() == 0 and repair.turns().count() == 0


@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "x"]), st.sampled_from(["A.", "b", "", "C!"])), max_size=8), st.integers(1, 3))
@settings(max_examples=300, deadline=None)
def test_search_equals_table_and_blocks(turns, block):
    rows = [(0, 0, *t) for t in turns]
    found = faults(rows)
    kinds = bytes(kind_of(r, t, f == "duplicate") for (r, t), f in zip(turns, found))
    cost, audit = cheapest(kinds)
    want = brute(rows, found)
    assert (cost, audit) == want[:2]
    assert tuple(edited(audit, *([t[i] for t in turns] for i in range(2)))) == want[2]
    assert put_together(from_every_state(kinds[i : i + block]) for i in range(0, len(kinds), block))[:2] == (cost, audit)


def test_least_by_trying_all_audits():
    for turns in product([("user", "A."), ("assistant", "B"), ("system", "C.")], repeat=3):
        kinds = bytes(kind_of(r, t, False) for r, t in turns)
        least = None
        for n in range(7):
            for audit in map("".join, product("DIKR", repeat=n)):
                if n - audit.count("I") != 3:
                    continue
                state, cost, rows = "", 0, iter(turns)
                for edit in audit:
                    if edit == "I":
                        cost, state = cost + 2, {"u": "a"}.get(state, "u")
                        continue
                    role, text = next(rows)
                    if edit == "D":
                        cost += 3
                        continue
                    cost += (text[-1] not in ".!?") + 2 * (edit == "R")
                    to = {"u": "a"}.get(state, "u") if edit == "R" or not (role == "system" and state == "") else "s"
                    if edit == "K" and role[0] != to:
                        break
                    state = to
                else:
                    if state in ("", "a"):
                        least = min(least or (cost, audit), (cost, audit))
        # six edits are enough for three rows: none needs more than three insertions
        assert cheapest(kinds) == least, turns


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert reports(QUERIES["op11_conversation_repair"](spark, SF)) == expected(rows)
