"""Conversation repair against a plain search over all edits, on the test table, on odd rows and on long conversations cut into chunks."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import cache
from itertools import product

import pytest

from quadrat.llm import conversation_repair as repair
from quadrat.llm.queries import QUERIES, damaged_turns

SF = "/root/testdata/sf0.001"
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
FULL = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """rows: (role initial, must go, truncated) -> (cost, audit), by trying every edit from the front."""

    @cache
    def best(k, state, inserted):
        options = [(0, "")] if k == len(rows) and state in ("", "a") else []
        if inserted < 3:
            options += [(3 + c, "I" + e) for r in "ua" if (state, r) in STEP for c, e in [best(k, STEP[state, r], inserted + 1)]]
        if k < len(rows):
            initial, must_go, truncated = rows[k]
            options += [(4 + c, "D" + e) for c, e in [best(k + 1, state, 0)]]
            if not must_go:
                extra = 3 * truncated
                if (state, initial) in STEP:
                    c, e = best(k + 1, STEP[state, initial], 0)
                    options.append((extra + c, "K" + e))
                for r in "ua":
                    if (state, r) in STEP:
                        c, e = best(k + 1, STEP[state, r], 0)
                        options.append((3 + extra + c, "R" + e))
        return min(options, default=(10**9, ""))

    for k in range(len(rows), 0, -1):  # from the end on, so that no call goes deep
        for state in ("", "s", "u", "a"):
            best(k, state, 0)
    return best(0, "", 0)


def damage(rows):
    """rows: (conv, turn, role, text)"""
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        name = ":".join(" " if v is None else str(v) for v in (conv, turn))
        case = zlib.crc32(name.encode()) % 20
        if case == 0:
            continue
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        role = "user" if case == 4 else role
        yield from [(conv, turn, role, text)] * (2 if case == 3 else 1)


def plain_report(original, rows):
    """original: conversations; rows: turns after damage -> the query's rows."""
    by_conv = defaultdict(list)
    for row in rows:
        by_conv[row[0]].append(row[1:])
    for conv in set(original):
        own = sorted(by_conv[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, facts, counts = set(), [], [0, 0, 0]
        for _, role, text in own:
            rest = text.rstrip("\x20\t\n\x0b\x0c\r")
            fault = 0 if not rest else 1 if (role, text) in seen else 2 if rest[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            facts.append((role[:1], fault in (0, 1), fault == 2))
        known = {t for t, _, _ in own if t is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(facts, facts[1:]))
        cost, audit = cheapest(tuple(facts))
        out, state, k = [], "", 0
        for letter in audit:
            if letter == "I":
                state = next(STEP[state, r] for r in "ua" if (state, r) in STEP)
                out.append(FULL[state] + ":")
                continue
            _, role, text = own[k]
            k += 1
            if letter != "D":
                initial = role[:1] if letter == "K" else next(r for r in "ua" if (state, r) in STEP)
                state = STEP[state, initial]
                out.append((role if letter == "K" else FULL[state]) + ":" + text)
        assert state in ("", "a")
        yield conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_registered_query(spark):
    turns = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op11_conversation_repair"][0](spark, SF)
    assert got.columns == COLUMNS
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"] * 2
    want = sorted(plain_report([t[0] for t in turns], damage(turns)))
    assert sorted(map(tuple, got.collect())) == want
    assert {letter for r in want for letter in r[7]} == set("DIKR")


def odd_turns():
    return [
        (1, None, "user", "first?"), (1, 2, None, None), (1, 5, "", "no role."), (1, 5, "assistant", "same turn."), (1, 5, "assistant", "same turn."),
        (2, 0, "system", "s."), (2, 1, "system", "t."), (2, 2, "USER", "u"), (2, 3, "ubot", " "),
        (None, 1, "assistant", "of no conversation."), (None, 2, "user", "x" * 200_000),
    (3, None, "user", None), (3, 1, "user", "f"), (3, 2, "assistant", "if.f \f"), (4, 0, "user", " \t\n"), (5, 0, "user", "a."), (5, 1, "assistant", "b. \x0b"), (6, -4, "s", "."), (6, 9, "a", "!\x85"),
        *[(7, k, "user", "all the same.") for k in range(50)],
        *[(8, 1, "assistant", "a repeated row") for _ in range(30)],
    ]


SCHEMA = "conv_id long, turn long, role string, text string, conv string, first string, audit string, kind string"


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_odd_rows_in_few_and_many_chunks(spark, parts):
    rows = odd_turns()
    table = spark.createDataFrame([(*r, "w", "x", "y", None) for r in rows], SCHEMA)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = repair.report(table, repair.repair(table)).collect()
        damaged = repair.report(table, repair.repair(damaged_turns(table))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    key = lambda r: (r[0] is not None, r[0] or 0)
    convs = [r[0] for r in rows]
    assert sorted(map(tuple, got), key=key) == sorted(plain_report(convs, plain), key=key)
    assert sorted(map(tuple, damaged), key=key) == sorted(plain_report(convs, damage(rows)), key=key)


def test_long_conversations_over_many_chunks(spark):
    rng = random.Random(5)
    rows = []
    for conv in range(4):
        for turn in range(300 if conv else 900):
            text = rng.choice(["", "ends.", "does not", f"own {rng.random()}!", f"own {rng.random()}"])
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool"]), text))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 24)
    try:
        done = repair.repair(table)
        assert done.pieces.where("conv = 0").count() > 8  # spread over tasks
        assert sorted(map(tuple, repair.report(table, done).collect())) == sorted(plain_report([r[0] for r in rows], rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_empty_table(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    done = repair.repair(table)
    assert repair.report(table, done).count() == 0 and done.turns.count() == 0


def test_grammar_gives_the_sequences_back():
    rng = random.Random(3)
    sequences = [bytes(rng.choices(range(9), (4, 1, 6, 1, 6, 1, 1, 1, 2), k=rng.randint(1, 60))) for _ in range(80)]
    sequences += [bytes([2]) * n for n in (1, 2, 3, 4, 5, 8, 33)] + [bytes([2, 4]) * 40]
    rules, tops = repair.pair_up(sequences)
    full = [bytes([k]) for k in range(repair.MUST_GO + 1)]
    for a, b in rules:
        full.append(full[a] + full[b])
    assert [full[t] for t in tops] == sequences
    assert len(set(rules)) == len(rules) < sum(map(len, sequences)) / 2  # parts are shared


def test_every_short_sequence():
    """All sequences of up to three symbols, and longer ones at random, against the plain search."""
    rng = random.Random(8)
    sequences = [bytes(s) for n in (1, 2, 3) for s in product(range(9), repeat=n)]
    sequences += [bytes(rng.choices(range(9), k=rng.randint(4, 14))) for _ in range(400)]
    rules, tops = repair.pair_up(sequences)
    grammar = repair.Grammar(rules)
    for sequence, top in zip(sequences, tops):
        q = repair.best_end(grammar.cost[top, 0].tolist(), grammar.order[top, 0].tolist())
        audit, roles = grammar.read(top, 0, q)
        audit, roles = audit + "I" * len(repair.CLOSING[q]), roles + repair.CLOSING[q]
        rows = tuple(("suax"[c // 2] if c < 8 else "x", c == 8, bool(c % 2) and c < 8) for c in sequence)
        assert (grammar.cost[top, 0, q] + 3 * len(repair.CLOSING[q]), audit) == cheapest(rows)
        assert re.fullmatch("(s?(ua)+)?", roles.replace("-", "")) and len(roles) == len(audit)
