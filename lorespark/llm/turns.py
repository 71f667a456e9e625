"""Conversation structure repair: a higher-order fold over sorted turns in Spark SQL.

A conversation is sound if its role initials read ``(s?(ua)+)?`` and no turn is
blank (no character but white space), duplicate (same role and text as an
earlier turn) or truncated (its last character but white space is none of
``.!?``); a turn has the first of these faults only.  Edits: Keep costs nothing,
Rerole (to user or assistant) 1, Delete 2 and is a must for blank and duplicate
turns, Insert (an empty user or assistant turn) 5, and a truncated turn that
stays costs 5 more.  The cheapest edits win, among equal ones those whose
initials in order (the audit) are least.

The fold: faults come from window functions; a chunk's turns are collected as
sorted structs; ``aggregate`` carries one ``(cost, audit)`` struct for each of
four states (nothing yet, system, user, assistant last) and takes native
``least`` of the ways into a state.  Audits of one cost and state are never
prefixes of each other, so the least one so far stays the least one.

How it scales: rows are dealt and sorted by range, equal rows too, and stored
with their place, so that a conversation that holds a third of all rows lies in
many partitions; a chunk has at most ``CHUNK`` turns of one conversation and
partition.  Chunks that don't begin a conversation are folded from each of the
four states; a second fold chains the chunks of a conversation and compares
audits at equal costs only.  Windows and groups go by (conversation, partition),
or see one row a partition.  All steps but the last work on narrow rows without
texts.  What a result row itself must hold, the audit, passes one task: a letter
a turn, so a conversation is limited to the 2 GB of a string.

Defined results: a null conversation is a conversation; null turns come first;
equal turns are ordered by role, then by the text's first ``PREFIX`` characters,
then by its SHA-256; a null or empty role has no initial and can't be kept, nor
can any other than s, u and a; null roles and texts count as ``NULL`` (one
space); repeated rows are duplicates; an empty table gives an empty result.  Only
the four columns are used, whatever else the table has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import scratch, table

CHUNK = 256
PREFIX = 64
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NEVER = 10**15
NULL = " "
SPACES = " \t\n\x0b\x0c\r"
#: Every how many (conversation, turn) keys one is damaged in each of five ways.
DAMAGE = 20
START, SYSTEM, USER, ASSISTANT = range(4)


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def damaged(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` with every fifth part of ``DAMAGE`` dropped, emptied, cut, repeated or made a user's."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(NULL)), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(NULL)))
    way = F.crc32(key.cast("binary")) % DAMAGE
    some = rows.select("conv_id", "turn", F.coalesce("role", F.lit(NULL)).alias("role"), F.coalesce("text", F.lit(NULL)).alias("text"), way.alias("way")).where("way <> 0")
    text = F.when(F.col("way") == 1, F.lit("")).when(F.col("way") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("way") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.when(F.col("way") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return some.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_")).drop("_")


def placed(rows: DataFrame) -> DataFrame:
    """Rows by range, with ``c`` (the conversation), ``part`` and ``id``, ascending within the conversation; stored.

    Also what the fold needs of a text: ``blank``, ``cut`` and a digest of role and text.
    """
    c = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    role, text = F.coalesce("role", F.lit(NULL)), F.coalesce("text", F.lit(NULL))
    trimmed = F.rtrim("text", F.lit(SPACES))
    full = rows.select(c.alias("c"), "turn", role.alias("role"), text.alias("text")).withColumn("sha", F.unhex(F.sha2("text", 256)))
    full = full.withColumns({"head": F.left("text", F.lit(PREFIX)), "row": F.monotonically_increasing_id()})
    order = ["c", F.col("turn").asc_nulls_first(), "role", "head", "sha", "row"]
    ordered = full.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"part": F.spark_partition_id(), "id": F.monotonically_increasing_id()})
    initial = F.when(F.left("role", F.lit(1)).isin("s", "u", "a"), F.left("role", F.lit(1))).otherwise("")
    said = F.unhex(F.sha2(F.concat_ws("\n", F.length("role").cast("string"), "role", "text"), 256))
    return _stored(
        ordered.select(
            "c", "turn", "part", "id", "role", "text", initial.alias("initial"), F.left("role", F.lit(1)).alias("letter"), said.alias("said"),
            (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut"),
        ),
        "turns-placed",
    )


def chunked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``chunk``, the piece of at most ``CHUNK`` turns of its conversation and partition."""
    own = Window.partitionBy("c", "part").orderBy("id")
    return rows.withColumn("chunk", F.floor((F.row_number().over(own) - 1) / CHUNK).cast("int"))


def faults(rows: DataFrame) -> DataFrame:
    """Narrow rows with ``chunk`` and ``fault``: 1 blank, 2 duplicate, 3 truncated, else 0; stored."""
    narrow = chunked(rows.select("c", "turn", "part", "id", "initial", "letter", "said", "blank", "cut"))
    again = F.row_number().over(Window.partitionBy("c", "part", "said").orderBy("id")) > 1
    once = _stored(narrow.withColumn("again", again), "turns-seen")
    # conversations in several partitions: two a partition at most
    crossing = F.broadcast(once.groupBy("c", "part").agg(F.lit(1)).groupBy("c").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select("c"))
    across = once.join(crossing, "c", "left_semi")
    later = across.where("not again").select("id", F.row_number().over(Window.partitionBy("c", "said").orderBy("part")).alias("k")).where("k > 1").select(F.col("id").alias("_later"))
    flagged = across.join(later, F.col("id") == F.col("_later"), "left").withColumn("again", F.col("again") | F.col("_later").isNotNull()).select(once.columns)
    every = once.join(crossing, "c", "left_anti").union(flagged)
    fault = F.when(F.col("blank"), 1).when(F.col("again"), 2).when(F.col("cut"), 3).otherwise(0)
    return _stored(every.select("c", "turn", "part", "chunk", "id", "initial", "letter", fault.alias("fault")), "turns-faults")


def _state(cost: Column, audit: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), audit.cast("string").alias("audit"))


def _plus(state: Column, cost: int | Column, letter: str | Column) -> Column:
    one = F.lit(letter) if isinstance(letter, str) else letter
    return _state(state["cost"] + (F.lit(cost) if isinstance(cost, int) else cost), F.concat(state["audit"], one))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _inserted(acc: Column) -> Column:
    """The states after any inserts that can help."""
    user = F.least(acc["s2"], *(_plus(acc[s], INSERT, "I") for s in ("s0", "s1", "s3")))
    return _let(user, lambda u: F.struct(acc["s0"].alias("s0"), acc["s1"].alias("s1"), u.alias("s2"), F.least(acc["s3"], _plus(u, INSERT, "I")).alias("s3")))


def _step(acc: Column, turn: Column) -> Column:
    """The states after a turn ``(id, initial, fault)``."""

    def after(at: Column) -> Column:
        more = F.when(turn["fault"] == 3, TRUNCATED).otherwise(0)
        stays = ~turn["fault"].isin(1, 2)

        def into(state: Column, came: Column, initial: str, rerole: bool) -> Column:
            kept = turn["initial"] == initial
            way = _plus(came, more + F.when(kept, 0).otherwise(REROLE), F.when(kept, F.lit("K")).otherwise(F.lit("R")))
            gone = _plus(state, DELETE, "D")
            return F.when(stays & (F.lit(True) if rerole else kept), F.least(gone, way)).otherwise(gone)

        before_user = F.least(at["s0"], at["s1"], at["s3"])
        return F.struct(
            _plus(at["s0"], DELETE, "D").alias("s0"), into(at["s1"], at["s0"], "s", False).alias("s1"),
            into(at["s2"], before_user, "u", True).alias("s2"), into(at["s3"], at["s2"], "a", True).alias("s3"),
        )

    return _let(_inserted(acc), after)


def folded(turns: Column, entry: Column) -> Column:
    """Four ``(cost, audit)`` structs after sorted ``turns``, begun in the state ``entry``."""
    begin = F.struct(*(_state(F.when(entry == s, 0).otherwise(NEVER), F.lit("")).alias(f"s{s}") for s in range(4)))
    return F.aggregate(turns, begin, _step)


def matrices(rows: DataFrame) -> DataFrame:
    """A row a chunk with its counts, ends, and ``ways``: for each entry state the four states after it; stored.

    ``nth`` numbers the chunks of a conversation.
    """
    pair = F.concat("before", "letter")
    pairs = Window.partitionBy("c", "part", "chunk").orderBy("id")
    own = rows.withColumns({"before": F.lag("letter").over(pairs), "turn_before": F.lag("turn").over(pairs)})
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    # at most CHUNK structs
    chunks = own.groupBy("c", "part", "chunk").agg(
        F.array_sort(F.collect_list(F.struct("id", "initial", "fault"))).alias("turns"),
        F.min("turn").alias("least_turn"), F.max("turn").alias("most_turn"), count(F.col("turn").isNotNull() & (F.col("turn_before").isNull() | (F.col("turn") != F.col("turn_before")))).alias("turn_values"),
        count(F.col("fault") == 1).alias("blank"), count(F.col("fault") == 2).alias("duplicate"), count(F.col("fault") == 3).alias("truncated"),
        count(F.col("before").isNotNull() & ~pair.isin("su", "ua", "au")).alias("illegal"), F.min_by("letter", "id").alias("first_letter"), F.max_by("letter", "id").alias("last_letter"),
    )
    along = Window.partitionBy("c").orderBy("part", "chunk")
    joint = F.concat(F.lag("last_letter").over(along), F.col("first_letter"))
    numbered = chunks.withColumns({
        "nth": F.row_number().over(along), "illegal": F.col("illegal") + F.when(joint.isNotNull() & ~joint.isin("su", "ua", "au"), 1).otherwise(0),
        "turn_values": F.col("turn_values") - F.when(F.lag("most_turn").over(along) == F.col("least_turn"), 1).otherwise(0),
    })
    entries = F.when(F.col("nth") == 1, F.array(F.lit(START))).otherwise(F.array(*(F.lit(s) for s in range(4))))
    return _stored(numbered.withColumn("ways", F.transform(entries, lambda e: folded(F.col("turns"), e))).drop("turns", "first_letter", "last_letter"), "turns-ways")


def _chained(ways: Column) -> Column:
    """Four ``(cost, audit, path)`` structs after the chunks' ``ways`` in order."""
    path = F.array().cast("array<int>")
    begin = F.array(*(F.struct(F.lit(0 if s == START else NEVER).cast("long").alias("cost"), F.lit("").alias("audit"), path.alias("path")) for s in range(4)))

    def into(acc: Column, way: Column, x: int) -> Column:
        entries = F.sequence(F.lit(0), F.size(way) - 1)
        cost = lambda e: F.get(acc, e)["cost"] + F.get(way, e)[f"s{x}"]["cost"]
        join = lambda e: F.struct(cost(e).alias("cost"), F.concat(F.get(acc, e)["audit"], F.get(way, e)[f"s{x}"]["audit"]).alias("audit"), F.concat(F.get(acc, e)["path"], F.array(F.lit(x))).alias("path"))
        return _let(F.array_min(F.transform(entries, cost)), lambda least: F.array_min(F.transform(F.filter(entries, lambda e: cost(e) == least), join)))

    return F.aggregate(ways, begin, lambda acc, way: F.array(*(into(acc, way, x) for x in range(4))))


def _ended(states: Column) -> Column:
    """The cheapest legal end: nothing, assistant, or what inserts make of user and system; ``path`` and inserts ``tail``."""
    ends = [(START, 0), (ASSISTANT, 0), (USER, 1), (SYSTEM, 2)]
    at = lambda s: F.get(states, F.lit(s))
    return F.least(*(F.struct((at(s)["cost"] + n * INSERT).alias("cost"), F.concat(at(s)["audit"], F.lit("I" * n)).alias("audit"), at(s)["path"].alias("path"), F.lit(n).alias("tail")) for s, n in ends))


@dataclass
class Repaired:
    """What a repair finds; ``c`` is the conversation as text, "=" before it, empty for null."""

    #: ``(c, gaps, blank, duplicate, truncated, illegal, cost, audit)`` of each conversation.
    conversations: DataFrame
    #: ``(c, nth, last, turns)``: the repaired turns ``(edit, role, text)`` of each chunk, deleted ones left out.
    chunks: DataFrame


def _replayed(turns: Column, audit: Column, entry: Column) -> Column:
    """The repaired turns ``(edit, role, text)`` of sorted ``turns``, by an audit's letters."""
    kind = "array<struct<edit:string,role:string,text:string>>"
    begin = F.struct(F.lit(0).alias("at"), F.element_at(F.array(*map(F.lit, ("", "s", "u", "a"))), entry + 1).alias("last"), F.array().cast(kind).alias("out"))

    def step(acc: Column, letter: Column) -> Column:
        turn = F.get(turns, acc["at"])
        role = F.when(letter == "K", turn["role"]).when(acc["last"] == "u", F.lit("assistant")).otherwise(F.lit("user"))
        one = F.struct(letter.alias("edit"), role.alias("role"), F.when(letter == "I", F.lit("")).otherwise(turn["text"]).alias("text"))
        return F.struct(
            (acc["at"] + F.when(letter == "I", 0).otherwise(1)).alias("at"), F.when(letter == "D", acc["last"]).otherwise(F.left(role, F.lit(1))).alias("last"),
            F.when(letter == "D", acc["out"]).otherwise(F.concat(acc["out"], F.array(one).cast(kind))).alias("out"),
        )

    return F.aggregate(F.filter(F.split(audit, ""), lambda x: x != ""), begin, step)["out"]


def repair(rows: DataFrame) -> Repaired:
    """Cheapest repair of all conversations of ``rows(conv_id, turn, role, text)``."""
    stored = placed(rows)
    ways = matrices(faults(stored))
    total = lambda x: F.sum(x).alias(x)
    gaps = F.coalesce(F.max("most_turn") - F.min("least_turn") + 1 - F.sum("turn_values"), F.lit(0)).alias("gaps")
    # a conversation's chunks: as much as its audit, sixteen times over
    along = F.array_sort(F.collect_list(F.struct("nth", "part", "chunk", "ways")))
    found = ways.groupBy("c").agg(gaps, total("blank"), total("duplicate"), total("truncated"), total("illegal"), along.alias("along"))
    found = _stored(found.withColumn("end", _ended(_chained(F.transform("along", lambda x: x["ways"])))), "turns-repaired")
    audit = lambda x, k: F.get(x["ways"], F.when(k == 0, START).otherwise(F.get(F.col("end.path"), k - 1)))
    out = lambda x, k: F.element_at(F.array(*(audit(x, k)[f"s{s}"]["audit"] for s in range(4))), F.get(F.col("end.path"), k) + 1)
    tail = lambda k: F.when(k == F.size("along") - 1, F.repeat(F.lit("I"), F.col("end.tail"))).otherwise("")
    piece = lambda x, k: F.struct(x["part"].alias("part"), x["chunk"].alias("chunk"), x["nth"].alias("nth"), (k == F.size("along") - 1).alias("last"), F.when(k == 0, START).otherwise(F.get(F.col("end.path"), k - 1)).alias("entry"), F.concat(out(x, k), tail(k)).alias("audit"))
    pieces = found.select("c", F.explode(F.transform("along", piece)).alias("p")).select("c", "p.*")
    by_part = pieces.groupBy("c", "part").agg(F.map_from_entries(F.collect_list(F.struct("chunk", F.struct("nth", "last", "entry", "audit")))).alias("audits"))
    texts = chunked(stored.select("c", "part", "id", "role", "text")).groupBy("c", "part", "chunk").agg(F.array_sort(F.collect_list(F.struct("id", "role", "text"))).alias("turns"))
    own = F.col("audits")[F.col("chunk")]
    chunks = texts.join(by_part, ["c", "part"]).select("c", own["nth"].alias("nth"), own["last"].alias("last"), _replayed(F.col("turns"), own["audit"], own["entry"]).alias("turns"))
    return Repaired(found.select("c", "gaps", "blank", "duplicate", "truncated", "illegal", "end.cost", "end.audit"), _stored(chunks, "turns-chunks"))


def turns_of(repaired: Repaired) -> DataFrame:
    """Repaired turns as rows: ``(c, nth, at, edit, role, text)``, in order of ``nth`` and ``at``."""
    return repaired.chunks.select("c", "nth", F.posexplode("turns").alias("at", "t")).select("c", "nth", "at", "t.*")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations from their sorted pieces; one running hash, no piece is kept."""
    now, running, begun = None, hashlib.sha256(), False
    for batch in batches:
        out = []
        for c, piece in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if c != now:
                if now is not None:
                    out.append((now, running.hexdigest()))
                now, running, begun = c, hashlib.sha256(), False
            if piece.is_valid:
                running.update(b"\n" if begun else b"")
                running.update(piece.as_buffer())
                begun = True
        yield pa.record_batch({"c": pa.array([x for x, _ in out], pa.string()), "repaired_sha256": pa.array([x for _, x in out], pa.string())})
    if now is not None:
        yield pa.record_batch({"c": [now], "repaired_sha256": [running.hexdigest()]})


def digests(repaired: Repaired) -> DataFrame:
    """``(c, repaired_sha256)`` of ``role:text`` lines.

    Conversations of one chunk are hashed where they are; the pieces of longer
    ones are sorted into one task a conversation, as a SHA-256 goes in order, and
    stream through it.
    """
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    pieces = repaired.chunks.select("c", "nth", "last", F.when(F.size("turns") > 0, lines).alias("piece"))
    short = (F.col("nth") == 1) & F.col("last")
    whole = pieces.where(short).select("c", F.sha2(F.coalesce("piece", F.lit("")), 256).alias("repaired_sha256"))
    long = pieces.where(~short).repartition("c").sortWithinPartitions("c", "nth").select("c", "piece").mapInArrow(_hashed, "c string, repaired_sha256 string")
    return whole.union(long)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults and cheapest repair, after the contract's damage."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repair(damaged(rows))
    c = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    every = rows.select("conv_id").distinct().withColumn("c", c)
    longs = [F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found.conversations, "c", "left").join(digests(found), "c", "left").select(
        "conv_id", *longs, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256")
    )


def _sql() -> str:
    state = lambda s, cost, letter, text: f"{{'c': {s}.c + {cost}, 'a': {s}.a || {letter}, 't': {s}.t || {text}}}"
    line = "chr(10) || role || ':' || text"
    plus_i = lambda s, role: state(s, 5, "'I'", f"chr(10) || '{role}:'")
    gone = lambda s: state(s, 2, "'D'", "''")
    way = lambda s, initial, role: state(s, f"(CASE WHEN fault = 3 THEN 5 ELSE 0 END) + (CASE WHEN initial = '{initial}' THEN 0 ELSE 1 END)", f"(CASE WHEN initial = '{initial}' THEN 'K' ELSE 'R' END)", f"(CASE WHEN initial = '{initial}' THEN {line} ELSE chr(10) || '{role}:' || text END)")
    never = "{'c': 1000000000::BIGINT, 'a': '', 't': ''}"
    return f"""
WITH RECURSIVE bits(v, k, x) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT v, k + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM bits WHERE k < 8),
crcs AS (SELECT list(x ORDER BY v) AS t FROM bits WHERE k = 8),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
ways AS (SELECT k.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)), lambda acc, b: xor(acc >> 8, t[(xor(acc, b) & 255) + 1])), 4294967295) % 20 AS way FROM keyed k, crcs),
bad AS (SELECT conv_id, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role, CASE way WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM ways, range(2) r(i) WHERE way <> 0 AND (i = 0 OR way = 3)),
marked AS (SELECT *, row_number() OVER w AS rn, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed,
    left(role, 1) AS letter, lag(left(role, 1)) OVER w || left(role, 1) AS pair FROM bad WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
turns AS MATERIALIZED (SELECT *, CASE WHEN trimmed = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 THEN 2 WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, CASE WHEN letter IN ('s', 'u', 'a') THEN letter ELSE '' END AS initial FROM marked),
fold AS (
    SELECT conv_id, 0::BIGINT AS rn, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS s0, {never} AS s1, {never} AS s2, {never} AS s3 FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL
    SELECT conv_id, rn, {gone("i0")}, CASE WHEN stays AND initial = 's' THEN least({gone("i1")}, {way("i0", "s", "system")}) ELSE {gone("i1")} END,
        CASE WHEN stays THEN least({gone("i2")}, {way("least(i0, i1, i3)", "u", "user")}) ELSE {gone("i2")} END, CASE WHEN stays THEN least({gone("i3")}, {way("i2", "a", "assistant")}) ELSE {gone("i3")} END
    FROM (SELECT *, least(s3, {plus_i("i2", "assistant")}) AS i3 FROM (
        SELECT f.conv_id, t.rn, t.fault, t.initial, t.role, t.text, t.fault NOT IN (1, 2) AS stays, s0 AS i0, s1 AS i1, s3, least(s2, {plus_i("s0", "user")}, {plus_i("s1", "user")}, {plus_i("s3", "user")}) AS i2
        FROM fold f JOIN turns t ON f.conv_id IS NOT DISTINCT FROM t.conv_id AND t.rn = f.rn + 1))),
ends AS (SELECT conv_id, least(s0, s3, {plus_i("s2", "assistant")}, {state("s1", 10, "'II'", "chr(10) || 'user:' || chr(10) || 'assistant:'")}) AS e FROM fold QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY rn DESC) = 1),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, e.e.c AS cost, e.e.a AS audit, sha256(substr(e.e.t, 2)) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""


#: The same result in DuckDB: a recursive fold over the turns of each conversation.
SQL = _sql()
