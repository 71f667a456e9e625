"""Chat formatting: minimum-cost role repair, then rendering.

Legal conversations are ``[system] (user assistant)+``.  Every turn of a
conversation gets a label; a label other than the turn's role costs
``RELABEL`` (``GUESS`` where the role is none of the three), a turn that takes
the label before it merges into that turn for ``MERGE``, and empty turns that
the automaton needs in between or at the end cost ``INSERT`` each.  Dynamic
programming over the automaton's states finds the cheapest labels; among equal
costs the labels that are smallest (system, user, assistant) from the end
backwards win, so the result doesn't depend on how rows are partitioned.

``repair`` returns one row a turn, with its label, action and ``segment``: the
rendered text that the turn adds, with headers, inserted empty turns, and the
end mark of the turn before.  A conversation's rendering is its segments in
order, so no conversation is ever assembled in one row or task.

How it scales: rows are range-partitioned and sorted by one and the same order,
which splits a conversation that holds a third of all rows over many partitions,
equal rows too.  A
part of a split conversation acts on the four states as a (min, +) matrix; the
first pass sends one matrix a split end, at most two a partition, and the
driver chains them to fix every part's first and last state; the second pass
runs the programme within each part.  Both passes read one checkpoint.

Defined results: conv_id null is a conversation of its own; null turns come
first; equal (conv_id, turn) are ordered by role, then by the text's first
``PREFIX`` characters, then by a hash of the text; a null or unknown role is
guessed; a null text renders as empty; repeated rows are turns of their own (wholly
equal ones are interchangeable and may be split anywhere); an empty table gives an empty result.  Only the four columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import checkpointed, table

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
RELABEL, GUESS, MERGE, INSERT = 4, 1, 1, 3
NEVER = 10**9
PREFIX = 64
HEAD, TAIL = "<|im_start|>{}\n", "<|im_end|>\n"

RESULT = T.StructType(
    [
        T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
        T.StructField("new_role", T.StringType()), T.StructField("action", T.StringType()), T.StructField("inserted", T.IntegerType()),
        T.StructField("cost", T.IntegerType()), T.StructField("segment", T.StringType()),
    ]
)
PARTS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("last", T.BooleanType()), T.StructField("opens", T.BooleanType()), T.StructField("key", T.StringType()), T.StructField("costs", T.ArrayType(T.LongType())), T.StructField("order", T.ArrayType(T.IntegerType()))])


def _ways() -> dict[tuple[int, int], tuple[int, ...]]:
    """For states p and q the fewest empty turns to insert so that q may follow, () for none."""
    out = {}
    for p in range(4):
        seen, edge = {}, [((), p)]
        while edge:
            nxt = []
            for path, at in edge:
                for q in LEGAL[at]:
                    if q not in seen:
                        seen[q] = path
                        nxt.append(((*path, q), q))
            edge = nxt
        out |= {(p, q): path for q, path in seen.items()}
    return out


_WAYS = _ways()


def step(p: int, q: int) -> tuple[int, bool, tuple[int, ...]]:
    """Cheapest way for a turn labelled ``q`` after state ``p``: cost, merged, inserted states."""
    options = []
    if (p, q) in _WAYS:
        options.append((INSERT * len(_WAYS[p, q]), False, _WAYS[p, q]))
    if p == q:
        options.append((MERGE, True, ()))
    return min(options, key=lambda x: (x[0], x[1])) if options else (NEVER, False, ())


_STEPS = [[step(p, q) for q in range(4)] for p in range(4)]
_CLOSING = {s: (() if s == ASSISTANT else (*_WAYS[s, ASSISTANT], ASSISTANT)) for s in range(4)}


def label_cost(role: str | None, q: int) -> int:
    if role not in ROLES:
        return GUESS
    return 0 if ROLES[q - 1] == role else RELABEL


def viterbi(roles: list[str | None], entry: dict[int, int]) -> tuple[dict[int, int], list[list[int]]]:
    """Costs of the states after the last turn, and each turn's best state before, by state.

    ``entry`` has the costs of the states before the first turn.  Equal costs
    keep the smallest state before.
    """
    now, back = dict(entry), []
    for role in roles:
        new, came = {}, [-1] * 4
        for q in (SYSTEM, USER, ASSISTANT):
            own = label_cost(role, q)
            best = min(((c + _STEPS[p][q][0] + own, p) for p, c in now.items() if _STEPS[p][q][0] < NEVER), default=None)
            if best is not None:
                new[q], came[q] = best
        now = new
        back.append(came)
    return now, back


def trace(back: list[list[int]], state: int) -> list[int]:
    """The states from before the first turn to after the last, ending in ``state``."""
    out = [state]
    for came in reversed(back):
        out.append(came[out[-1]])
    return out[::-1]


def matrix(roles: list[str | None]) -> tuple[list[int], list[int]]:
    """Costs by 4 * entry + exit, and for each exit the entries ordered as ties are broken."""
    costs, paths = [NEVER] * 16, {}
    for e in range(4):
        ends, back = viterbi(roles, {e: 0})
        for x, c in ends.items():
            costs[4 * e + x] = c
            paths[e, x] = trace(back, x)[::-1]
    order = []
    for x in range(4):
        order += sorted(range(4), key=lambda e: (paths.get((e, x), [9]), e))
    return costs, order


def final_cost(state: int) -> int:
    return INSERT * len(_CLOSING[state])


def chain(parts: list[tuple[list[int], list[int]]]) -> list[int]:
    """States at the cuts of a conversation of several parts, the end's last."""
    reach = [{START: 0}]
    for costs, _ in parts:
        before = reach[-1]
        reach.append({x: c for x in range(4) if (c := min(before[e] + costs[4 * e + x] for e in before)) < NEVER})
    state = min(reach[-1], key=lambda s: (reach[-1][s] + final_cost(s), s))
    out = [state]
    for k in range(len(parts) - 1, -1, -1):
        costs, order = parts[k]
        least = min(reach[k][e] + costs[4 * e + state] for e in reach[k])
        state = next(e for e in order[4 * state : 4 * state + 4] if e in reach[k] and reach[k][e] + costs[4 * e + state] == least)
        out.append(state)
    return out[::-1]


def render(turns: list[tuple], entry: int = START, leave: int | None = None, closes: bool = True) -> list[tuple]:
    """Result rows for consecutive turns ``(conv_id, turn, role, text)`` of one conversation."""
    roles = [t[2] for t in turns]
    ends, back = viterbi(roles, {entry: 0})
    if leave is None:
        leave = min(ends, key=lambda s: (ends[s] + (final_cost(s) if closes else 0), s))
    states = trace(back, leave)
    out = []
    for k, (conv, turn, role, text) in enumerate(turns):
        p, q = states[k], states[k + 1]
        cost, merged, inserted = _STEPS[p][q]
        cost += label_cost(role, q)
        segment = "\n" if merged else ("" if p == START else TAIL) + "".join(HEAD.format(ROLES[s - 1]) + TAIL for s in inserted) + HEAD.format(ROLES[q - 1])
        segment += text or ""
        count = len(inserted)
        if closes and k == len(turns) - 1:
            segment += TAIL + "".join(HEAD.format(ROLES[s - 1]) + TAIL for s in _CLOSING[q])
            cost, count = cost + final_cost(q), count + len(_CLOSING[q])
        changed = ROLES[q - 1] != role
        action = {(False, False): "keep", (True, False): "relabel", (False, True): "merge", (True, True): "relabel_merge"}[changed, merged]
        out.append((conv, turn, role, ROLES[q - 1], action, count, cost, segment))
    return out


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, list[tuple]]]:
    """Runs of equal ``key`` in sorted rows, across batches."""
    key, held = None, []
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            if held and row[0] != key:
                yield key, held
                held = []
            key = row[0]
            held.append(tuple(None if x is None or x != x else x for x in row[1:]))
    if held:
        yield key, held


def repair(conversations: DataFrame) -> DataFrame:
    """Repaired turns of ``conversations(conv_id, turn, role, text)``, in the form of ``RESULT``."""
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    whole = F.coalesce(F.col("turn").cast("string"), F.lit(""))
    ordered = ["conv_id", "turn", "role", "_head", "_hash"]
    placed = conversations.select("conv_id", "turn", "role", "text", F.substring("text", 1, PREFIX).alias("_head"), F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_any"))
    rows = placed.repartitionByRange(*ordered, "_any").sortWithinPartitions(*ordered)
    rows = checkpointed(rows.select(key.alias("key"), whole.alias("turn"), "role", "text"))

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, out = TaskContext.get().partitionId(), []
        before, k = None, 0
        for name, turns in _groups(batches):
            # the first and the last conversation of a partition may go on elsewhere
            roles = [t[1] for t in turns]
            if k == 0:
                out.append((part, False, True, name, *matrix(roles)))
            else:
                before = name, roles
            k += 1
        if before is not None:
            out.append((part, True, True, before[0], *matrix(before[1])))
        yield pd.DataFrame(out, columns=PARTS.names)

    pieces = rows.select("key", "turn", "role").mapInPandas(ends, PARTS).collect()  # two rows a partition at most
    pieces.sort(key=lambda r: (r["part"], r["last"]))
    known: dict[tuple[int, bool], tuple[int, int | None, bool]] = {}
    k = 0
    while k < len(pieces):
        end = k + 1
        while end < len(pieces) and pieces[end]["key"] == pieces[k]["key"] and pieces[end]["part"] != pieces[end - 1]["part"]:
            end += 1
        run = pieces[k:end]
        states = chain([(r["costs"], r["order"]) for r in run])
        for i, r in enumerate(run):
            known[r["part"], r["last"]] = states[i], states[i + 1], i == len(run) - 1
        k = end

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, out, size = TaskContext.get().partitionId(), [], 0
        groups, k = _groups(batches), 0
        now = next(groups, None)
        while now is not None:
            ahead = next(groups, None)
            name, turns = now
            conv = int(name) if name else None
            fixed = known.get((part, False)) if k == 0 else known.get((part, True)) if ahead is None else None
            entry, leave, closes = fixed or (START, None, True)
            full = [(conv, int(t[0]) if t[0] else None, t[1], t[2]) for t in turns]
            out += render(full, entry, leave, closes)
            size += sum(len(t[2] or "") for t in turns)
            if size > 4_000_000 or len(out) > 20_000:
                yield _typed(out)
                out, size = [], 0
            now, k = ahead, k + 1
        yield _typed(out)

    return rows.mapInPandas(solve, RESULT)


def _typed(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=RESULT.names, dtype=object).astype({"conv_id": "Int64", "turn": "Int64", "inserted": "int32", "cost": "int32"})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn's repaired role and rendered segment."""
    return repair(table(spark, sf_dir, "conversations"))
