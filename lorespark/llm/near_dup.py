"""MinHash near-dedup: Order MinHash candidates, verified by banded alignment.

Two documents are near-duplicates if the edit similarity of their word
sequences, ``1 - distance / longer length``, is at least ``THRESHOLD``.

Order MinHash: the k-mers of a text are its ``K``-word shingles, each labelled
with its occurrence number.  One hash deals them into ``SKETCHES`` bins; of each
bin the two labelled k-mers with the smallest values are put back in text order
and hashed to one key, so texts with the same words in another order differ,
which plain MinHash can't see.  Two k-mers agree too seldom near the threshold,
so the ``SINGLES`` labelled k-mers of least hash are keys, too.  Texts with a
key in common share a bucket:

- in a bucket of at most ``FEW`` texts all pairs are candidates;
- in a larger one every text is a candidate of the bucket's smallest, which
  gives n - 1 pairs and not n**2.

The smallest text joins what is like it at little cost, so that large groups of
copies have one root before the rest is sought: in every larger bucket all pairs
of texts with different roots are compared by lengths and word counts, inside
blocks of at most ``BLOCK`` texts of like length and between two blocks at a time.
What counts leave is aligned there, by two bytes a word, which never makes texts less
alike than they are.  So only pairs that are alike by these codes leave a block, no
more than join its roots to classes; their words decide.  A first pass tries every pair
of different roots, in the first bucket that the pair shares and those most alike by
counts first.  Where words refuse one, a second pass lists all such pairs of its bucket.
So no pair is left out; the comparisons of a bucket grow with the square of its different
roots, in memory for two blocks, the rows that leave it don't.

Pairs whose lengths or word counts (in ``BINS`` bins) exclude the threshold are
dropped, which loses nothing; the others are aligned inside a band that is as
wide as the threshold allows, and verified pairs are joined to classes by
connected components.

How it scales: equal texts (by MD5) collapse first, on the map side, so a text
that a third of all rows share is one node.  The bucket shuffles carry two
64-bit numbers a key; should two texts agree in the short number, both are
looked at.  Texts of larger buckets carry 150 bytes a key, cut into blocks within
range partitions, and a pair of blocks is a group of its own, so a bucket is dealt
over all tasks.  Words travel only for texts that pass the filters on lengths and
counts.  Bucket minima and component minima are partial aggregates; joins that
meet a hot key have stored tables on both sides, so that adaptive execution can
split them.  Nothing is collected.  Shuffle files go as soon as their query ends
(``shared.tidy``), and tables are compared a few MB at a time (``CELLS``, ``HELD``), as a
worker's memory comes on top of its executor's heap.

Defined results: a text without words (null, empty, signs only) is nobody's
duplicate; a text with fewer than ``K`` words is one k-mer of all its words;
``class_id`` is the smallest doc_id of the class (null ids only count if there
is no other); repeated rows share a class; an empty table gives an empty result.
Extra columns are ignored by ``classes`` and kept by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .alignment import similar
from .components import components
from .shared import broadcast_if_small, checkpointed, fresh, scratch, texts_table, tidy
from .words import mix, ngram_hashes, word_hashes

K = 5
SKETCHES = 16
THRESHOLD = 0.8
#: Keys that are a single shingle each; the least hashes of a text, so that two texts pick alike.
SINGLES = 24
#: Buckets of at most so many texts are tried pair by pair.
FEW = 16
#: Larger ones are compared in blocks of at most so many texts and bytes of codes (a longer text is a block of its own).
BLOCK, BLOCK_BYTES = 4096, 4 << 20
#: Counts compared at once, and words of a block whose counts are kept.
CELLS, HELD = 1 << 20, 1 << 20
#: Bins of the word counts that pairs are compared by before their words are fetched.
BINS = 128
#: Coarser bins of the same counts, compared inside buckets.
COARSE = 32
#: Nodes (16 bytes each) whose texts are wanted may be broadcast up to so many; beyond, words are shuffled.
WANTED = 1_000_000


def labelled_kmers(words: np.ndarray, k: int = K) -> np.ndarray:
    """K-mer hashes in text order, the i-th repeat of a k-mer told from the first."""
    if not len(words):
        return words
    h = ngram_hashes(words, min(k, len(words)))
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    if new.all():
        return h
    begin = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    repeat = np.zeros(len(s), np.uint64)
    repeat[order] = (np.arange(len(s)) - begin).astype(np.uint64)
    return np.where(repeat > 0, mix(h + repeat * np.uint64(0x9E3779B97F4A7C15)), h)


def order_keys(words: np.ndarray, k: int = K) -> np.ndarray | None:
    """The Order MinHash keys of a text, one a bin that has k-mers; None without words.

    They are odd numbers, the keys of single shingles are even ones.
    """
    h = labelled_kmers(words, k)
    if not len(h):
        return None
    place = np.argsort(h, kind="stable")
    dealt = (h[place] % np.uint64(SKETCHES)).astype(np.int64)
    order = np.argsort(dealt, kind="stable")
    begin = np.searchsorted(dealt[order], np.arange(SKETCHES + 1))
    bins = np.flatnonzero(begin[1:] > begin[:-1])
    first = place[order[begin[bins]]]
    second = place[order[np.minimum(begin[bins] + 1, begin[bins + 1] - 1)]]
    key = mix(bins.astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + h[np.minimum(first, second)])
    return mix(key * np.uint64(0xD6E8FEB86659FD93) + h[np.maximum(first, second)]) | np.uint64(1)


def shingle_keys(words: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` labelled k-mers of least hash, as even numbers."""
    h = labelled_kmers(words)
    return (h if len(h) <= n else np.partition(h, n)[:n]) & ~np.uint64(1)


def word_bag(words: np.ndarray) -> bytes:
    """Words counted in bins, up to 255 each."""
    return np.minimum(np.bincount((words >> np.uint64(32)).astype(np.int64) % BINS, minlength=BINS), 255).astype(np.uint8).tobytes()


def word_codes(words: np.ndarray) -> bytes:
    """Two bytes a word, in text order: equal words have equal codes."""
    return (words >> np.uint64(32)).astype("<u2").tobytes()


@F.pandas_udf(T.StructType([T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("size", T.IntegerType()), T.StructField("bag", T.BinaryType()), T.StructField("code", T.BinaryType())]))
def _sketch_udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        found = [word_hashes(t) for t in texts]
        keys = [order_keys(w) for w in found]
        yield pd.DataFrame({"keys": pd.Series([None if x is None else np.concatenate([x, shingle_keys(w, SINGLES)]).view(np.int64) for x, w in zip(keys, found, strict=True)], dtype=object), "size": [len(w) for w in found], "bag": pd.Series([word_bag(w) for w in found], dtype=object), "code": pd.Series([word_codes(w) for w in found], dtype=object)})


@F.pandas_udf(T.BooleanType())
def _bags_udf(a: pd.Series, b: pd.Series, limit: pd.Series) -> pd.Series:
    """Whether no more than ``limit`` words are surplus on either side; an edit changes either surplus by one at most."""
    diff = np.frombuffer(b"".join(a), np.uint8).reshape(-1, BINS).astype(np.int16) - np.frombuffer(b"".join(b), np.uint8).reshape(-1, BINS)
    return pd.Series(np.maximum(np.maximum(diff, 0).sum(1), np.maximum(-diff, 0).sum(1)) <= limit.to_numpy())


def _fitting_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs ``(a, b)`` of different roots in ``members(id, root, size, coarse)`` of each bucket that sizes and coarse counts don't exclude."""
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            column = whole.column(0).slice(at, 4096)
            n = np.diff(column.offsets.to_numpy())
            all_of = column.flatten()
            ids, roots, sizes = (all_of.field(x).to_numpy(zero_copy_only=False) for x in ("id", "root", "size"))
            coarse = np.frombuffer(b"".join(all_of.field("coarse").to_pylist()), np.uint8).reshape(-1, COARSE).astype(np.int16)
            begin = np.cumsum(n) - n
            # the i-th member with each of those after it
            left = np.repeat(np.arange(len(ids)), np.repeat(begin + n, n) - np.arange(len(ids)) - 1)
            first = np.repeat(np.cumsum(np.repeat(begin + n, n) - np.arange(len(ids)) - 1) - (np.repeat(begin + n, n) - np.arange(len(ids)) - 1), np.repeat(begin + n, n) - np.arange(len(ids)) - 1)
            right = left + 1 + np.arange(len(left)) - first
            limit = np.floor((1 - THRESHOLD) * np.maximum(sizes[left], sizes[right]) + 1e-9)
            near = (roots[left] != roots[right]) & (np.abs(sizes[left] - sizes[right]) <= limit)
            left, right, limit = left[near], right[near], limit[near]
            for k in range(0, len(left), 1 << 18):
                x, y = left[k : k + (1 << 18)], right[k : k + (1 << 18)]
                diff = coarse[x] - coarse[y]
                fits = np.maximum(np.maximum(diff, 0).sum(1), np.maximum(-diff, 0).sum(1)) <= limit[k : k + (1 << 18)]
                x, y = ids[x[fits]], ids[y[fits]]
                yield pa.record_batch({"a": np.minimum(x, y), "b": np.maximum(x, y)})


BLOCKS = "key long, n int, lo int, hi int, least long, most long, ids binary, roots binary, sizes binary, codes binary, hots binary, manys binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(key, id, root, size, code, hot)``, or with ``bag`` for the last two, in order of key and size as ``BLOCKS`` of one key each."""
    held: list[tuple] = []

    def block(names: list[str]) -> pa.RecordBatch:
        key, ids, roots, sizes = (np.concatenate([h[i] for h in held]) for i in range(4))
        more = [b"".join(h[i] for h in held) for i in range(4, len(held[0]))]
        held.clear()
        row = (int(key[0]), len(ids), int(sizes[0]), int(sizes[-1]), int(roots.min()), int(roots.max()), ids.tobytes(), roots.tobytes(), sizes.tobytes(), *more)
        kinds = (pa.int64(), *[pa.int32()] * 3, *[pa.int64()] * 2, *[pa.binary()] * (3 + len(more)))
        return pa.record_batch([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], ["key", "n", "lo", "hi", "least", "most", "ids", "roots", "sizes", *names])

    names: list[str] = []
    for batch in batches:
        key, ids, roots, sizes = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        payload = batch.column(4).to_pylist()
        ends = np.cumsum([0, *map(len, payload)])
        names = ["bags"]
        if batch.num_columns > 5:
            names = ["codes", "hots", "manys"]
            many = np.diff(batch.column(5).offsets.to_numpy()).astype(np.int32)
            hot, last = batch.column(5).flatten().to_numpy(), np.concatenate([[0], np.cumsum(many)])
        at = 0
        for end in [*(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)] if len(key) else []:
            while at < end:
                room = BLOCK_BYTES - sum(len(h[4]) for h in held)
                to = min(end, at + BLOCK - sum(len(h[0]) for h in held), max(int(np.searchsorted(ends, ends[at] + room, "right")) - 1, at + (not held)))
                if held and (held[0][0][0] != key[at] or to <= at):
                    yield block(names)
                    continue
                held.append((key[at:to], ids[at:to], roots[at:to], sizes[at:to], b"".join(payload[at:to]), *((hot[last[at] : last[to]].tobytes(), many[at:to].tobytes()) if batch.num_columns > 5 else ())))
                at = to
    if held:
        yield block(names)


def _ranges(x: dict, y: dict | None) -> tuple[dict, dict, np.ndarray, np.ndarray, np.ndarray]:
    """``x`` and ``y`` (None: ``x`` with itself) in the order in which fewer pairs are looked at, and ranges ``left, begin, end``: texts of ``y`` that ``x[left]`` meets."""
    alone, y = y is None, x if y is None else y
    reach = 1 / THRESHOLD
    here = np.arange(len(x["size"]))
    # by length: what no other length may be like is passed over
    end = np.searchsorted(y["size"], np.floor(x["size"] * reach + 1e-6), "right")
    begin = here + 1 if alone else np.searchsorted(y["size"], np.ceil(x["size"] / reach - 1e-6), "left")
    # by root: what is linked already is passed over
    by = lambda z, order: {k: v[order] for k, v in z.items()}
    xr, yr = by(x, np.argsort(x["root"], kind="stable")), by(y, np.argsort(y["root"], kind="stable"))
    before, after = np.searchsorted(yr["root"], xr["root"], "left"), np.searchsorted(yr["root"], xr["root"], "right")
    left, start, stop = (here, after, np.full(len(here), len(here))) if alone else (np.concatenate([here, here]), np.concatenate([np.zeros_like(before), after]), np.concatenate([before, np.full(len(here), len(yr["root"]))]))
    if (stop - start).sum() < np.maximum(end - begin, 0).sum():
        return xr, yr, left, start, stop
    return x, y, here, begin, np.maximum(end, begin)


def _apart(x: dict, y: dict | None, best: bool, chosen=None) -> pa.RecordBatch:
    """Pairs of different roots in one block, or between two, that lengths, counts and ``chosen`` (places of pairs of rows to keep) don't exclude; ``best``: of each two roots those most alike."""
    x, y, left, begin, end = _ranges(x, y)
    n = end - begin
    total, found = np.cumsum(n), []
    of = lambda c: (c.astype(np.float32), c.sum(1, dtype=np.int64))
    sides = [[of(z["bag"].reshape(-1, COARSE, z["bag"].shape[1] // COARSE).sum(2, dtype=np.int32)), of(z["bag"])] for z in (x, y)]
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + (1 << 17), "right")))
        m = n[lo:hi]
        i = np.repeat(left[lo:hi], m)
        k = np.arange(len(i)) + np.repeat(begin[lo:hi] - (np.cumsum(m) - m), m)
        lo = hi
        limit = np.floor((1 - THRESHOLD) * np.maximum(x["size"][i], y["size"][k]) + 1e-9)
        near = (x["root"][i] != y["root"][k]) & (np.abs(x["size"][i] - y["size"][k]) <= limit)
        i, k, limit = i[near], k[near], limit[near]
        # coarse counts first, for what they leave the finer ones
        for (cx, sx), (cy, sy) in zip(*sides, strict=True):
            apart, step = np.empty(len(i)), max(1, CELLS // cx.shape[1])
            for at in range(0, len(i), step):
                p, q = i[at : at + step], k[at : at + step]
                diff = cx[p]
                diff -= cy[q]
                # the surpluses of both sides are half of their sum and difference
                apart[at : at + step] = (np.abs(diff, out=diff) @ np.ones(diff.shape[1], np.float32) + np.abs(sx[p] - sy[q])) / 2
            fits = apart <= limit
            i, k, limit, apart = i[fits], k[fits], limit[fits], apart[fits]
        if best and len(i):
            one, two = np.minimum(x["root"][i], y["root"][k]), np.maximum(x["root"][i], y["root"][k])
            order = np.lexsort((apart, two, one))
            first = np.ones(len(order), bool)
            first[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
            i, k, apart = i[order[first]], k[order[first]], apart[order[first]]
        if chosen is not None:
            # those most alike first, as they join roots
            order = np.argsort(apart, kind="stable")
            i, k = i[order], k[order]
            kept = chosen(x["row"][i].tolist(), y["row"][k].tolist())
            i, k = i[kept], k[kept]
        found.append((x["id"][i], y["id"][k]))
    a, b = (np.concatenate([f[s] for f in found]) if found else np.zeros(0, np.int64) for s in (0, 1))
    return pa.record_batch({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _opened(block: dict) -> dict:
    number = lambda c, t: np.frombuffer(block[c], t)
    size = number("sizes", np.int32).astype(np.int64)
    row = np.arange(len(size))
    if "codes" in block:
        bag, end = np.zeros((len(size), 256), np.uint8), np.cumsum(size)
        lo = 0
        while lo < len(size):
            at = int(end[lo] - size[lo])
            hi = max(lo + 1, int(np.searchsorted(end, at + HELD // 4, "right")))
            code = number("codes", "<u2")[at : end[hi - 1]] & np.uint16(255)
            bag[lo:hi] = np.minimum(np.bincount(np.repeat(row[: hi - lo], size[lo:hi]) * 256 + code, minlength=256 * (hi - lo)), 255).reshape(-1, 256)
            lo = hi
    else:
        bag = number("bags", np.uint8).reshape(-1, BINS)
    return {"id": number("ids", np.int64), "root": number("roots", np.int64), "size": size, "bag": bag, "row": row}


def told_apart(values: np.ndarray) -> np.ndarray:
    """``values`` below 2**32 in order, each with the number of its repeat in the lower 32 bits."""
    s = np.sort(values.astype(np.uint64))
    place = np.arange(len(s))
    begin = np.maximum.accumulate(np.where(np.concatenate([[True], s[1:] != s[:-1]])[: len(s)], place, 0))
    return s << np.uint64(32) | (place - begin).astype(np.uint64)


def surplus(a: np.ndarray, b: np.ndarray) -> int:
    """How many values of the longer side the other lacks; both are ``told_apart``."""
    both = np.sort(np.concatenate([a, b]))
    return max(len(a), len(b)) - np.count_nonzero(both[1:] == both[:-1])


class _Texts:
    """Codes, their counts, those of pairs of neighbours, and buckets of a block's texts."""

    def __init__(self, block: dict):
        self.root = np.frombuffer(block["roots"], np.int64)
        self.end = np.cumsum(np.concatenate([[0], np.frombuffer(block["sizes"], np.int32)]))
        self.last = np.cumsum(np.concatenate([[0], np.frombuffer(block["manys"], np.int32)]))
        self.codes, self.hot = np.frombuffer(block["codes"], "<u2"), np.frombuffer(block["hots"], np.int64)
        self.held_keys: dict[int, frozenset] = {}
        self.held_counts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.room = HELD

    def code(self, r: int) -> np.ndarray:
        return self.codes[self.end[r] : self.end[r + 1]]

    def keys(self, r: int) -> frozenset:
        if r not in self.held_keys:
            self.held_keys[r] = frozenset(self.hot[self.last[r] : self.last[r + 1]].tolist())
        return self.held_keys[r]

    def counts(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        if r not in self.held_counts:
            code = self.code(r).astype(np.uint32)
            if len(code) > self.room:
                self.held_counts.clear()
                self.room = HELD
            self.room -= len(code)
            self.held_counts[r] = told_apart(code), told_apart(code[:-1] << np.uint32(16) | code[1:])
        return self.held_counts[r]


def _alike(x: dict, y: dict | None, join: bool):
    """Places of the pairs of rows that have no earlier bucket in common and codes that are alike; ``join``: no more of them than join roots."""
    one = _Texts(x)
    two = one if y is None else _Texts(y)
    up: dict[int, int] = {}

    def top(r: int) -> int:
        while (over := up.get(r, r)) != r:
            up[r] = r = up.get(over, over)
        return r

    def chosen(left: list[int], right: list[int]) -> np.ndarray:
        kept = []
        for place, (i, k) in enumerate(zip(left, right, strict=True)):
            if min(one.keys(i) & two.keys(k)) != x["key"]:
                continue
            if join and (a := top(int(one.root[i]))) == (b := top(int(two.root[k]))):
                continue
            (p, pp), (q, qq) = one.counts(i), two.counts(k)
            limit = int((1 - THRESHOLD) * max(len(p), len(q)) + 1e-9)
            # an edit takes one code and two pairs of neighbours from either side at most
            if surplus(p, q) > limit or surplus(pp, qq) > 2 * limit or not similar(one.code(i), two.code(k), THRESHOLD):
                continue
            if join:
                up[a] = b
            kept.append(place)
        return np.array(kept, np.int64)

    return chosen


def _between(best: bool, join: bool = True):
    """Pairs of a group that holds one block, or two; blocks of codes give ``(a, b, key)``, without those that codes tell apart, and if ``join`` no more than join roots."""

    def pairs(group: pa.Table) -> pa.Table:
        x, y = (group.to_pylist() + [None])[:2]
        of_y = None if y is None else _opened(y)
        if "codes" not in x:
            return pa.Table.from_batches([_apart(_opened(x), of_y, best)])
        found = pa.Table.from_batches([_apart(_opened(x), of_y, best, _alike(x, y, join))])
        return found.append_column("key", pa.array(np.full(len(found), x["key"], np.int64)))

    return pairs


@F.pandas_udf(T.BinaryType())
def _words_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: (word_hashes(t) >> np.uint64(32)).astype("<u4").tobytes())


@F.pandas_udf(T.BooleanType())
def _similar_udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([similar(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), THRESHOLD) for x, y in zip(a, b, strict=True)], dtype=bool)


def node(text: Column) -> Column:
    """The identity of a text: equal texts are one node."""
    return F.unhex(F.md5(text.cast("binary")))


def bucketed(entries: DataFrame) -> DataFrame:
    """``(key, id, n)`` of the entries whose key has n > 1 texts; stored."""
    shared = _stored(entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-keys")
    return _stored(entries.join(shared, "key"), "buckets")


def candidates(shared: DataFrame) -> DataFrame:
    """Distinct pairs ``(a, b)`` of small buckets, and of larger buckets' smallest texts with their others, whose further pairs ``crowded_links`` seeks."""
    hot = shared.where(F.col("n") > FEW)
    least = checkpointed(hot.groupBy("key").agg(F.min("id").alias("a")))
    star = hot.join(least, "key").where("id <> a").select("a", F.col("id").alias("b"))
    # at most FEW ids each
    ids = shared.where(F.col("n") <= FEW).groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    pair = F.explode(F.flatten(F.transform("ids", lambda x, i: F.transform(F.slice("ids", i + 2, FEW), lambda y: F.struct(x.alias("a"), y.alias("b"))))))
    few = ids.select(pair.alias("p")).select("p.a", "p.b")
    return star.union(few).distinct()


def grown(found: DataFrame, new: DataFrame) -> DataFrame:
    """Components ``found(node, root)`` after the links ``new(a, b)``: only the roots that these join are worked on."""
    of = lambda x: found.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    ends = new.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    top = checkpointed(components(ends))
    over = top.select(F.col("node").alias("root"), F.col("root").alias("_over"))
    return checkpointed(found.join(over, "root", "left").select("node", F.coalesce("_over", "root").alias("root")).union(top))


def crowds(hot: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """``(key, id, root, size, code, hot)`` of the entries ``hot(key, id)`` of buckets whose texts have different roots; ``hot`` has all such buckets of a text."""
    mine = nodes.select("id", "node").join(found, "node", "left").select("id", "node", F.xxhash64(F.coalesce("root", "node")).alias("root"))
    all_of = _stored(hot.select("key", "id").distinct().join(mine, "id").select("key", "id", "node", "root"), "crowds")
    mixed = checkpointed(all_of.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key"))
    entries = all_of.join(broadcast_if_small(mixed), "key", "left_semi")
    # as many as a text has keys
    buckets = entries.groupBy("id").agg(F.collect_set("key").alias("hot"))
    return entries.join(buckets, "id").join(nodes.select("node", "size", "code"), "node").select("key", "id", "root", "size", "code", "hot")


def between_blocks(entries: DataFrame, join: bool) -> DataFrame:
    """Pairs ``(a, b, key)`` of different roots of ``entries(key, id, root, size, code, hot)`` that have a key in common and are not excluded."""
    order = ("key", "size", "id")
    rows = entries.repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = _stored(rows.mapInArrow(_cut, BLOCKS).withColumn("block", F.monotonically_increasing_id()), "blocks")
    of = lambda x: blocks.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("block", "lo", "hi", "least", "most")])
    like = lambda x, y: F.col(f"hi_{x}") + 1 >= F.col(f"lo_{y}") * THRESHOLD
    apart = F.least("least_x", "least_y") != F.greatest("most_x", "most_y")
    met = of("x").join(of("y"), "key").where((F.col("block_x") <= F.col("block_y")) & like("x", "y") & like("y", "x") & apart)
    sides = checkpointed(met.select("block_x", "block_y", F.explode(F.array_distinct(F.array("block_x", "block_y"))).alias("block")))
    whole = blocks.select("block", "key", "ids", "roots", "sizes", "codes", "hots", "manys").join(broadcast_if_small(sides), "block")
    # blocks are small and costly to compare, so they are dealt by number, not by bytes
    spark = entries.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return whole.repartition(parts, "block_x", "block_y").groupBy("block_x", "block_y").applyInArrow(_between(False, join), "a long, b long, key long")


def crowded_links(texts: DataFrame, nodes: DataFrame, shared: DataFrame, found: DataFrame) -> DataFrame:
    """Components ``found(node, root)`` with all links of the texts in buckets above ``FEW``."""
    hot = shared.where(F.col("n") > FEW)
    tried = None
    for join in (True, False):
        pairs = checkpointed(between_blocks(crowds(hot, nodes, found), join))
        if tried is not None:
            pairs = checkpointed(pairs.join(tried, ["a", "b"], "left_anti"))
        new = checkpointed(links(texts, pairs.select("a", "b").distinct(), nodes))
        found = found if new.isEmpty() else grown(found, new)
        if join:
            # where words refuse a pair, others may not have been listed because of it
            held = new.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
            refused = checkpointed(pairs.join(held, ["a", "b"], "left_anti").select("key").distinct())
            if refused.isEmpty():
                break
            hot, tried = hot.join(broadcast_if_small(refused), "key", "left_semi"), pairs.select("a", "b").distinct()
    return found


def all_links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Components ``(node, root)`` of ``nodes(node, id, keys, size, bag, code)`` by the links of all buckets."""
    texts = docs.select(node(F.col("text")).alias("node"), "text")
    shared = bucketed(nodes.select("id", F.explode("keys").alias("key")))
    found = checkpointed(components(checkpointed(links(texts, checkpointed(candidates(shared)), nodes))))
    return found if shared.where(F.col("n") > FEW).isEmpty() else crowded_links(texts, nodes, shared, found)


def links(texts: DataFrame, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(a, b)``, nodes of the pairs of ids that alignment confirms; sizes and word counts are compared first."""
    of = lambda x: nodes.select(F.col("id").alias(x), F.col("node").alias(f"node_{x}"), F.col("size").alias(f"size_{x}"), F.col("bag").alias(f"bag_{x}"))
    limit = F.floor((1 - THRESHOLD) * F.greatest("size_a", "size_b") + 1e-9)
    near = pairs.join(of("b"), "b").join(of("a"), "a").where(F.abs(F.col("size_a") - F.col("size_b")) <= limit)
    near = checkpointed(near.where(_bags_udf("bag_a", "bag_b", limit)).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))
    ends = checkpointed(near.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    once = lambda x: x.select("node", _words_udf("text").alias("words")).groupBy("node").agg(F.first("words").alias("words"))
    few = ends.limit(WANTED + 1).count() <= WANTED
    needed = once(texts.join(F.broadcast(ends), "node", "left_semi")) if few else once(texts).join(ends, "node", "left_semi")
    needed = _stored(needed, "words")
    of_b = needed.select(F.col("node").alias("b"), F.col("words").alias("words_b"))
    of_a = needed.select(F.col("node").alias("a"), F.col("words").alias("words_a"))
    return near.join(of_b, "b").join(of_a, "a").where(_similar_udf("words_a", "words_b")).select("a", "b")


def _stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def wordless(text: Column) -> Column:
    return text.isNull() | ~F.rlike(text, F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]"))


def sketches(docs: DataFrame) -> DataFrame:
    """``(node, id, keys, size, bag, code)`` of every different text with words; stored."""
    sketched = docs.where(~wordless(F.col("text"))).select(node(F.col("text")).alias("node"), _sketch_udf("text").alias("s"))
    once = sketched.groupBy("node").agg(F.first("s").alias("s"))
    return _stored(once.select("node", F.xxhash64("node").alias("id"), "s.keys", "s.size", "s.bag", "s.code"), "nodes")


def classes(docs: DataFrame) -> DataFrame:
    """``(doc_id, node, root, class_id, keep)`` for every document of ``docs(doc_id, text)``.

    ``root`` names the class (null for wordless texts); ``keep`` marks the rows
    that carry its smallest doc_id (all of them, should several rows share it).
    """
    rows = _stored(docs.select("doc_id", node(F.col("text")).alias("node"), wordless(F.col("text")).alias("bare")), "rows")
    worded = rows.where("not bare")
    with tidy(docs.sparkSession):
        found = all_links(docs, sketches(docs))
    least = worded.groupBy("node").agg(F.min("doc_id").alias("least"))
    rooted = checkpointed(least.join(found, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")))
    # checkpointed, so that both sides of the join are dealt anew and a class with very many texts can be split
    of_root = checkpointed(rooted.groupBy("root").agg(F.min("least").alias("class_id")))
    of_node = rooted.select("node", "root").join(of_root, "root").select("node", "root", "class_id")
    with_class = worded.select("doc_id", "node").join(of_node, "node").select("doc_id", "node", "root", "class_id")
    alone = rows.where("bare").select("doc_id", "node", F.lit(None).cast("binary").alias("root"), F.col("doc_id").alias("class_id"))
    return with_class.union(alone).withColumn("keep", F.col("doc_id").eqNullSafe(F.col("class_id")))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each class: the one with the smallest doc_id.

    Wordless texts all stay.  Rows that agree in doc_id and text count as one
    document; where one doc_id is on several texts of a class, the text with the
    smallest MD5 stays.
    """
    named = classes(docs.select("doc_id", "text")).where("keep and root is not null").groupBy("root", "node", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    kept = checkpointed(named.groupBy("root").agg(F.min(F.struct("node", "doc_id", "n")).alias("k")).select(F.col("k.node").alias("_kept_node"), F.col("k.doc_id").alias("_kept_id"), F.col("k.n").alias("_kept_n")))
    of = fresh(docs, "_node")
    joined = docs.withColumn(of, node(F.col("text"))).join(kept, (F.col(of) == F.col("_kept_node")) & F.col("doc_id").eqNullSafe(F.col("_kept_id")))
    if kept.where("_kept_n > 1").limit(1).count():
        joined = joined.where("_kept_n = 1").union(joined.where("_kept_n > 1").dropDuplicates([of, "doc_id"]))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*columns).union(docs.where(wordless(F.col("text"))).select(*columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its near-duplicate class."""
    return classes(texts_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "keep")
