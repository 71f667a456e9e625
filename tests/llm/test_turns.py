import hashlib
import re
from itertools import product

import pytest
from pyspark.sql import functions as F

from lorespark.llm import turns as m
from lorespark.llm.queries import ORACLE_SQL, QUERIES

SPACE = " \t\n\x0b\x0c\r"
LEGAL = re.compile(r"(s?(ua)+)?")


def ordered(rows):
    """The rows ``(turn, role, text)`` of one conversation in order, nulls replaced."""
    full = [(t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows]
    return sorted(full, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.sha256(r[2].encode()).digest()))


def with_faults(rows):
    seen, out = set(), []
    for t, role, text in ordered(rows):
        trimmed = text.rstrip(SPACE)
        fault = 1 if not trimmed else 2 if (role, text) in seen else 3 if trimmed[-1] not in ".!?" else 0
        seen.add((role, text))
        out.append((t, role, text, fault))
    return out


def exhaustive(rows):
    """Cost, audit and repaired turns by trying all edits; at most two inserts a gap."""
    faulted = with_faults(rows)
    gaps = ["", "u", "a", "ua", "au"]
    best = None
    edits = []
    for _, role, text, fault in faulted:
        own = [(2, "D", "", None)]
        if fault not in (1, 2):
            more = 5 if fault == 3 else 0
            own += [(more, "K", role[:1] or "-", (role, text)), (more + 1, "R", "u", ("user", text)), (more + 1, "R", "a", ("assistant", text))]
        edits.append(own)
    for chosen in product(*edits):
        for between in product(gaps, repeat=len(faulted) + 1):
            initials = "".join(g + (e[2] if e else "") for g, e in zip(between, [*chosen, None], strict=True))
            if not LEGAL.fullmatch(initials):
                continue
            cost = sum(e[0] for e in chosen) + 5 * sum(map(len, between))
            audit = "".join("I" * len(g) + (e[1] if e else "") for g, e in zip(between, [*chosen, None], strict=True))
            lines = []
            for g, e in zip(between, [*chosen, None], strict=True):
                lines += [("user" if c == "u" else "assistant") + ":" for c in g] + ([f"{e[3][0]}:{e[3][1]}"] if e and e[3] else [])
            if best is None or (cost, audit) < best[:2]:
                best = cost, audit, "\n".join(lines)
    return best


def dynamic(rows):
    """The same for long conversations, by a plain programme over states."""
    states = {"": (0, "", ())}

    def closed(states):
        out = dict(states)
        for _ in range(2):
            for s, (c, a, t) in list(out.items()):
                q = "a" if s == "u" else "u"
                out[q] = min(out.get(q, (10**9, "", ())), (c + 5, a + "I", (*t, ("user:" if q == "u" else "assistant:"))))
        return out

    for _, role, text, fault in with_faults(rows):
        now, new = closed(states), {}
        for s, (c, a, t) in now.items():
            ways = [(s, (c + 2, a + "D", t))]
            if fault not in (1, 2):
                more = 5 if fault == 3 else 0
                targets = {"": "su", "s": "u", "u": "a", "a": "u"}[s]
                for q in targets:
                    if role[:1] == q:
                        ways.append((q, (c + more, a + "K", (*t, f"{role}:{text}"))))
                    elif q != "s":
                        ways.append((q, (c + more + 1, a + "R", (*t, ("user:" if q == "u" else "assistant:") + text))))
            for q, w in ways:
                new[q] = min(new.get(q, (10**9, "", ())), w)
        states = new
    ends = closed(states)
    c, a, t = min(ends[s] for s in ("", "a") if s in ends)
    return c, a, "\n".join(t)


def counts(rows):
    faulted = with_faults(rows)
    known = [t for t, *_ in faulted if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(faulted, faulted[1:], strict=False)]
    return gaps, *(sum(f == k for *_, f in faulted) for k in (1, 2, 3)), sum(p not in ("su", "ua", "au") for p in pairs)


def repaired(spark, conversations, partitions=3):
    rows = [(c, *r) for c, own in conversations.items() for r in own]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(partitions)
    found = m.repair(df.withColumn("c", F.lit("clash")).withColumn("id", F.lit(0)))
    return found, {r["c"]: r for r in found.conversations.join(m.digests(found), "c").collect()}


def assert_equal(got, conversations, plain):
    for c, own in conversations.items():
        r = got["" if c is None else f"={c}"]
        cost, audit, text = plain(own)
        assert (r["cost"], r["audit"]) == (cost, audit), c
        assert r["repaired_sha256"] == hashlib.sha256(text.encode()).hexdigest(), c
        assert (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"]) == counts(own), c


def test_same_as_sql(same_as_sql):
    same_as_sql(QUERIES["op12_turns"], ORACLE_SQL["op12_turns"])


def short_conversations():
    import random

    rng = random.Random(4)
    roles, texts = ["user", "assistant", "system", "tool", "User", "", None, "sage"], ["Yes.", "No", "", " \n", "Why?", None, "Ok!\t", "a b"]
    out = {k: [(rng.choice([None, 0, 1, 2, 5]), rng.choice(roles), rng.choice(texts)) for _ in range(rng.randint(1, 3))] for k in range(60)}
    out[None] = [(1, "user", "Hi."), (2, "assistant", "Hello."), (2, "assistant", "Hello.")]
    out[60] = [(0, "system", "Be kind."), (1, "user", "Hi."), (2, "assistant", "Hello.")]
    out[61] = [(0, "system", "Be kind.")]
    return out


def test_short_conversations_by_trying_all_edits(spark):
    some = short_conversations()
    assert_equal(repaired(spark, some)[1], some, exhaustive)
    assert_equal(repaired(spark, some)[1], some, dynamic)


def long_conversations(n):
    import random

    rng = random.Random(9)
    roles, texts = ["user", "assistant", "system", "tool"], ["Yes.", "No", "", "Why?", "Ok!"]
    return {k: [(i // 2, rng.choice(roles), rng.choice(texts) if rng.random() < 0.3 else f"{k} says {i}" + rng.choice([".", ".", "?", ","])) for i in range(size)] for k, size in enumerate([1, 2, n, 3, 2 * n, 1, 5, n])}


@pytest.mark.parametrize("chunk", [1, 3, 256])
def test_long_conversations_in_chunks_and_partitions(spark, monkeypatch, chunk):
    monkeypatch.setattr(m, "CHUNK", chunk)
    some = long_conversations(40)
    found, got = repaired(spark, some, 7)
    assert_equal(got, some, dynamic)
    rows = m.turns_of(found).orderBy("c", "nth", "at").collect()
    for c, own in some.items():
        assert "\n".join(f"{r['role']}:{r['text']}" for r in rows if r["c"] == f"={c}") == dynamic(own)[2]


def test_equal_rows_and_a_hot_conversation(spark):
    some = {1: [(0, "user", "Same.")] * 700, 2: [(i, "user" if i % 2 == 0 else "assistant", f"{i}.") for i in range(900)], 3: [(None, "user", "x.")] * 3}
    assert_equal(repaired(spark, some, 6)[1], some, dynamic)


def test_empty_and_very_long_texts(spark):
    empty, got = repaired(spark, {})
    assert got == {} and m.turns_of(empty).count() == 0
    some = {1: [(0, "user", "word " * 200_000 + "."), (1, "assistant", "word " * 200_000)]}
    assert_equal(repaired(spark, some)[1], some, dynamic)


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "A. b! c?") for c in range(30) for t in range(4)] + [(None, None, None, None)]
    got = {}
    for r in m.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        got.setdefault((r["conv_id"], r["turn"]), []).append((r["role"], r["text"]))
    for c, t, role, text in rows:
        blank = lambda x: " " if x is None else x
        way = zlib.crc32(f"{blank(c)}:{blank(t)}".encode()) % 20
        role, text = blank(role), blank(text)
        want = {0: [], 1: [(role, "")], 2: [(role, re.sub("[.!?]", "", text))], 3: [(role, text)] * 2, 4: [("user", text)]}.get(way, [(role, text)])
        assert got.get((c, t), []) == want
