"""Language ID: prediction by partial matching over bytes, with frozen statistics.

Each language has a tree of byte contexts of 0 to ``ORDER`` bytes with the
counts of the bytes that followed.  The code length of a byte is exact for
that tree: from the longest context that the tree has, a byte seen there costs
``log2((T + q) / n)`` (T the sum of the counts, q the distinct bytes, n its own
count), any other one costs the escape ``log2((T + q) / q)`` and goes on in the
next shorter context, from which the bytes that the longer one had are excluded
(T and q lose them); below the empty context all bytes not seen so far are
equally likely.  The language whose tree gives the text the shortest code is
predicted.  Code lengths are held in units of 2**-16 bit, so sums don't depend on
the order of additions.

How it scales: all learnable documents are counted.  A task counts the
``ORDER + 1``-grams of its rows and returns each once, Spark adds them up by
(language, gram), a language that holds a third of all rows included; shorter
contexts are sums of that table, the texts are never shuffled.  The trees reach
the driver with a proven bound: a tree has at most ``CELLS / languages**2``
entries, those whose count reaches a threshold that a histogram of the counts
gives (all, while they fit), so that the broadcast table of code lengths has
at most ``CELLS`` numbers of 4 bytes.  Scoring is one map over the documents:
the code lengths of known grams are looked up by a hash table over whole Arrow
batches in pieces of ``PIECE`` bytes; unknown grams walk the trees.

Defined results: a text that is null or has no letter is ``und`` with score 0, as
is every text when nothing can be learned; ``score`` is the share of the
predicted language in the sum of all likelihoods (1 if one language was
learned); equal code lengths go to the language that is first by code point.
Texts are lower-cased; a text starts in the context of ``ORDER`` zero bytes.
Learned from are rows with a doc_id, text and language outside the held-out
fold, repeated rows as often as they come; rows with a null doc_id are scored,
``held_out`` false.  Extra columns are carried through, columns named like the
results are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import fresh, scratch, texts_table

ORDER = 3
FOLDS, HELD = 3, 1
#: Code lengths in the broadcast table, 4 bytes each.
CELLS = 1 << 24
PIECE = 1 << 19
#: Distinct grams that a counting task holds before it merges or hands them on.
HELD_GRAMS = 1 << 21
UNIT = 1 << 16
#: Steps of the histogram of counts for each doubling.
STEPS = 8
UNKNOWN = "und"


def masks(order: int = ORDER) -> list[np.uint32]:
    return [np.uint32((1 << 8 * (k + 1)) - 1) for k in range(order + 1)]


def lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of the lower-cased texts, laid end to end; a null has none."""
    low = pc.utf8_lower(texts.cast(pa.large_string()))
    offsets = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
    data = low.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def grams(offsets: np.ndarray, data: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """The grams that end at the bytes ``lo`` to ``hi``: the byte, below it those before it in its text, else zeros."""
    begin = max(lo - ORDER, 0)
    b = np.concatenate((np.zeros(ORDER - (lo - begin), np.uint8), data[begin:hi])).astype(np.uint32)
    out = b[ORDER:].copy()
    for j in range(1, ORDER + 1):
        out |= b[ORDER - j : len(b) - j] << np.uint32(8 * j)
    starts = np.unique(offsets[(offsets > lo - ORDER) & (offsets < hi)]) - lo
    for j, mask in enumerate(masks()[:ORDER]):
        at = starts + j
        at = at[(at >= 0) & (at < len(out))]
        out[at] &= mask
    return out


def tallied(values: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, with their summed counts."""
    if not len(values):
        return values, np.zeros(0, np.int64)
    if counts is None:
        values = np.sort(values)
        first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
        return values[first], np.diff(first, append=len(values))
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return values[first], np.add.reduceat(counts, first)


def merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return tallied(np.concatenate([v for v, _ in found]), np.concatenate([c for _, c in found]))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, found in held.items():
            values, counts = merged(found)
            yield pa.record_batch({"lang": pa.array([lang] * len(values), pa.string()), "gram": values.astype(np.int64), "n": counts.astype(np.int64)})
        held.clear()

    for batch in batches:
        langs = batch.column(0)
        for lang in pc.unique(langs).to_pylist():
            offsets, data = lowered(batch.column(1).filter(pc.equal(langs, lang)))
            for lo in range(int(offsets[0]), int(offsets[-1]), PIECE):
                held.setdefault(lang, []).append(tallied(grams(offsets, data, lo, min(lo + PIECE, int(offsets[-1])))))
        if sum(len(v) for found in held.values() for v, _ in found) > HELD_GRAMS:
            for lang in held:
                held[lang] = [merged(held[lang])]
            if sum(len(found[0][0]) for found in held.values()) > HELD_GRAMS // 2:
                yield from rows()
    yield from rows()


def gram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``(lang, gram, n)`` of all rows of ``docs`` that have both."""
    some = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text")).where("lang is not null and text is not null")
    return some.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def level_counts(counts: DataFrame) -> DataFrame:
    """``(lang, level, gram, n)`` of the grams of 1 to ``ORDER + 1`` bytes that end the counted ones."""
    level = F.explode(F.sequence(F.lit(1), F.lit(ORDER + 1))).alias("level")
    cut = F.expr("gram & (shiftleft(1L, 8 * level) - 1L)").alias("gram")
    return counts.select("lang", level, "gram", "n").select("lang", "level", cut, "n").groupBy("lang", "level", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Level:
    """Entries of one length, ascending, and their contexts."""

    gram: np.ndarray
    n: np.ndarray
    context: np.ndarray = field(init=False)
    total: np.ndarray = field(init=False)
    distinct: np.ndarray = field(init=False)
    #: What the contexts' bytes count in the next shorter contexts.
    below: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.context, first, self.distinct = np.unique(self.gram >> 8, return_index=True, return_counts=True)
        self.total = np.add.reduceat(self.n, first) if len(first) else np.zeros(0, np.int64)
        self.below = np.zeros(len(first), np.int64)


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` in ascending ``keys``; -1 for none."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class Tree:
    """One language's contexts; ``levels[k]`` has the grams of ``k + 1`` bytes."""

    def __init__(self, level: np.ndarray, gram: np.ndarray, n: np.ndarray) -> None:
        self.levels = []
        for k in range(ORDER + 1):
            own = np.flatnonzero(level == k + 1)
            own = own[np.argsort(gram[own])]
            self.levels.append(Level(gram[own].astype(np.int64), n[own].astype(np.int64)))
        for k in range(1, ORDER + 1):
            here, under = self.levels[k], self.levels[k - 1]
            at = _find(under.gram, here.gram & ((1 << 8 * k) - 1))  # always there, as counts grow with shorter contexts
            here.below = np.bincount(np.searchsorted(here.context, here.gram >> 8), under.n[at], len(here.context)).astype(np.int64) if len(at) else here.below

    def bits(self, wanted: np.ndarray) -> np.ndarray:
        """Code lengths in bits of the last bytes of ``wanted`` after the bytes before."""
        cost, todo = np.zeros(len(wanted)), np.arange(len(wanted))
        above = np.full(len(wanted), -1)
        for k in range(ORDER, -1, -1):
            if not len(todo):
                return cost
            here = self.levels[k]
            g = wanted[todo].astype(np.int64) & ((1 << 8 * (k + 1)) - 1)
            at, entry = _find(here.context, g >> 8), _find(here.gram, g)
            total, distinct = np.zeros(len(todo)), np.zeros(len(todo))
            known, cut = at >= 0, above >= 0
            total[known], distinct[known] = here.total[at[known]], here.distinct[at[known]]
            if k < ORDER:
                longer = self.levels[k + 1]
                total[cut] -= longer.below[above[cut]]
                distinct[cut] -= longer.distinct[above[cut]]
            seen = entry >= 0
            cost[todo[seen]] += np.log2((total + distinct)[seen] / here.n[entry[seen]])
            escapes = ~seen & (distinct > 0)
            cost[todo[escapes]] += np.log2((total + distinct)[escapes] / distinct[escapes])
            todo, above = todo[~seen], at[~seen]
        cost[todo] += np.log2(max(256 - len(self.levels[0].gram), 1))
        return cost

    def units(self, wanted: np.ndarray) -> np.ndarray:
        return np.rint(self.bits(wanted) * UNIT).astype(np.int64)


_MULTIPLIER = np.uint32(0x9E3779B1)


class Places:
    """Open addressing over distinct 32-bit keys: whole arrays are looked up at once."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.shift, self.mask = keys, np.uint32(32 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        todo, place = np.arange(len(keys)), self._home(keys)
        while len(todo):
            free = todo[self.slots[place[todo]] < 0]
            self.slots[place[free]] = free
            todo = todo[self.slots[place[todo]] != todo]
            place[todo] = (place[todo] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULTIPLIER) >> self.shift).astype(np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Indexes of ``wanted`` in the keys; -1 for none."""
        if not len(self.keys):
            return np.full(len(wanted), -1, np.int32)
        place = self._home(wanted)
        out = self.slots[place]
        odd = np.flatnonzero((self.keys[out] != wanted) & (out >= 0))
        while len(odd):
            place[odd] = (place[odd] + 1) & self.mask
            out[odd] = self.slots[place[odd]]
            odd = odd[(self.keys[out[odd]] != wanted[odd]) & (out[odd] >= 0)]
        return out


class Model:
    """Trees by language and the code lengths of all grams that some tree has."""

    def __init__(self, trees: dict[str, Tree]) -> None:
        self.langs = sorted(trees)
        self.trees = [trees[x] for x in self.langs]
        every = [t.levels[ORDER].gram for t in self.trees]
        known = np.unique(np.concatenate(every)) if every else np.zeros(0, np.int64)
        self.places = Places(known.astype(np.uint32))
        self.lengths = [t.units(known).astype(np.int32) for t in self.trees]

    def code_lengths(self, texts: pa.Array) -> np.ndarray:
        """``(languages, texts)`` in units of 2**-16 bit."""
        offsets, data = lowered(texts)
        out = np.zeros((len(self.langs), len(texts)), np.int64)
        for lo in range(int(offsets[0]), int(offsets[-1]), PIECE):
            hi = min(lo + PIECE, int(offsets[-1]))
            g = grams(offsets, data, lo, hi)
            at = self.places.find(g)
            first, last = np.searchsorted(offsets, [lo, hi - 1], "right") - 1
            docs = np.flatnonzero(offsets[first : last + 1] < offsets[first + 1 : last + 2]) + first  # those that have bytes
            starts = np.maximum(offsets[docs] - lo, 0)
            missed = np.flatnonzero(at < 0)
            odd, back = np.unique(g[missed], return_inverse=True)
            for i, tree in enumerate(self.trees):
                each = self.lengths[i][at] if len(self.lengths[i]) else np.zeros(len(g), np.int32)
                if len(missed):
                    each[missed] = tree.units(odd)[back]
                out[i, docs] += np.add.reduceat(each, starts, dtype=np.int64)
        return out

    def predicted(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and its share of the likelihoods."""
        lengths = self.code_lengths(texts)
        best = lengths.argmin(0)
        more = (lengths - lengths[best, np.arange(len(best))]) / UNIT
        return best, 1 / np.exp2(-np.minimum(more, 1000)).sum(0)


def fold(doc_id: Column) -> Column:
    """The contract's fold: ``HELD`` is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def thresholds(levels: DataFrame, cells: int = CELLS) -> dict[str, int]:
    """Languages with the least histogram step whose entries, and all above it, fit the bound."""
    step = F.floor(F.log2("n") * STEPS).cast("int")
    # at most 64 * STEPS rows a language
    rows = levels.groupBy("lang", step.alias("step")).agg(F.count(F.lit(1)).alias("entries")).collect()
    by: dict[str, list] = {}
    for r in rows:
        by.setdefault(r["lang"], []).append((r["step"], r["entries"]))
    most, out = cells // max(len(by), 1) ** 2, {}
    for lang, steps in by.items():
        left, least = most, 64 * STEPS
        for at, entries in sorted(steps, reverse=True):
            left -= entries
            if left < 0:
                break
            least = at
        out[lang] = least
    return out


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", cells: int = CELLS) -> Model:
    """Trees of all learnable rows: those with all three columns, outside the held-out fold."""
    spark = docs.sparkSession
    own = F.col(f"`{doc_id}`")
    path = scratch(spark, "grams")
    level_counts(gram_counts(docs.where(own.isNotNull() & (fold(own) != HELD)), text, lang)).write.parquet(path)
    levels = spark.read.parquet(path)
    least = thresholds(levels, cells)
    if not least:
        return Model({})
    steps = spark.createDataFrame(sorted(least.items()), "_lang string, least int")
    kept = levels.join(F.broadcast(steps), F.col("lang") == F.col("_lang")).where(F.floor(F.log2("n") * STEPS) >= F.col("least"))
    found = kept.select("lang", "level", "gram", "n").toArrow()
    langs = found["lang"]
    trees = {}
    for name in least:
        rows = found.filter(pc.equal(langs, name))
        trees[name] = Tree(rows["level"].to_numpy(), rows["gram"].to_numpy(), rows["n"].to_numpy())
    return Model(trees)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shared.value
        for column in texts:
            best, share = known.predicted(column)
            yield pa.StructArray.from_arrays([pa.array(known.langs, pa.string()).take(pa.array(best)), pa.array(share)], ["lang_pred", "score"])

    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    if not model.langs:
        return docs.select(*kept, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    name, own = fresh(docs, "_guess"), F.col(f"`{text}`")
    lettered = F.coalesce(F.rlike(own, F.lit(r"\p{L}")), F.lit(False))
    found = docs.withColumn(name, of(own))
    return found.select(*kept, F.when(lettered, F.col(f"{name}.lang_pred")).otherwise(UNKNOWN).alias("lang_pred"), F.when(lettered, F.col(f"{name}.score")).otherwise(0.0).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language."""
    docs = texts_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs)
    held = F.coalesce(fold(F.col("doc_id")) == HELD, F.lit(False))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
