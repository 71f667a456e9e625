"""Vector code compression: product quantisation with an exact partial-distance search.

Components become integers, ``floor(SCALE * x)``; a vector is cut into ``PARTS``
equal consecutive parts, and each part position has a codebook of at most
``ENTRIES`` entries.  The codebook starts as that part of the vectors with the
least ids and is refined ``ROUNDS`` times (nearest entry, then the floor of each
component's mean).  A vector's code has one entry index a part.

Partial-distance search (``nearest``): the dimensions of a part are taken in
descending order of the codebook's variance.  After the first, each vector's
closest entry so far is measured in full, which gives its best complete
distance; every entry whose accumulated distance strictly exceeds the best one
is then masked out, and the arrays are compacted to the pairs of vector and
entry that are left.  Halfway the entry that then leads is measured, too.  An
accumulated distance never falls, and ties are kept, so the result is exact:
the nearest entry, the lower index among equal ones.

How it scales: each round is one map over the vectors that returns one row of
sums a (part, entry, position) and partition, added up by Spark on the map side
first; the codebooks (at most ``ENTRIES`` integers a dimension) are all that
passes the driver.  The encoded rows are written once; errors by label are one
aggregate, joined back as a broadcast where the counted labels are few, else by
a shuffle that adaptive execution may split.  No group is ever collected.

Defined results: vectors that are null, empty or hold a null, NaN or infinite
component are dropped, and so are those whose length is not that of the kept
vector with the least id (its length must be a multiple of ``PARTS``; rows of
other lengths are passed over in the search for it).  A null id is encoded, but
starts no codebook unless no row has an id, in which case nothing is kept.  An
id that several rows carry starts one entry, by its least vector; repeated rows
get equal codes.  Integers beyond ``bound(d)`` (2**28 at 4 components a part)
are cut to it, so that all distances fit 64 bits; sums over labels that do not
fit are cut to the largest long.  Fewer vectors than ``ENTRIES`` give smaller
codebooks.  An empty table gives an empty result.  Extra columns are carried
through; columns named like the results are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import broadcast_if_small, fresh, scratch, table

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Integers of vectors and pairs of vector and entry that are worked on at a time.
BLOCK = 1 << 20
LONGEST = (1 << 63) - 1


def bound(d: int) -> int:
    """The largest integer for which the squared distance of parts of ``d`` components fits 62 bits."""
    return 1 << ((62 - max(d - 1, 0).bit_length()) // 2 - 1)


def integers(values: np.ndarray, d: int) -> np.ndarray:
    most = float(bound(d))
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -most, most).astype(np.int64)


def variance_order(book: np.ndarray) -> np.ndarray:
    """Dimensions by descending variance over the entries; equal ones by position."""
    return np.argsort(-book.astype(np.float64).var(0), kind="stable")


def nearest(vectors: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of, and squared distance to, the nearest entry of ``book`` for each row of ``vectors``; both int64."""
    order = variance_order(book)
    v, b = vectors[:, order], book[:, order]
    n, d = v.shape
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    part = (v[:, :1] - b[None, :, 0]) ** 2
    best = ((v - b[part.argmin(1)]) ** 2).sum(1)
    row, entry = np.nonzero(part <= best[:, None])
    part = part[row, entry]
    for j in range(1, d):
        part = part + (v[row, j] - b[entry, j]) ** 2
        if 2 * j == d and d > 3:
            lead = np.lexsort((entry, part, row))
            lead = lead[np.searchsorted(row[lead], np.arange(n))]
            best = np.minimum(best, ((v - b[entry[lead]]) ** 2).sum(1))
        kept = part <= best[row]
        if not kept.all():
            row, entry, part = row[kept], entry[kept], part[kept]
    # rows ascend, and entries within a row: the first that has the least distance is the lowest
    start = np.searchsorted(row, np.arange(n))
    least = np.minimum.reduceat(part, start)
    hits = np.flatnonzero(part == least[row])
    return entry[hits[np.searchsorted(row[hits], np.arange(n))]], least


def encode(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances, both ``(n, parts)``, of integer vectors ``(n, parts, d)`` by ``books`` ``(parts, entries, d)``."""
    codes = np.zeros(vectors.shape[:2], np.int64)
    errors = np.zeros(vectors.shape[:2], np.int64)
    for p in range(vectors.shape[1]):
        codes[:, p], errors[:, p] = nearest(vectors[:, p], books[p])
    return codes, errors


def blocks(column: pa.Array, parts: int) -> Iterator[np.ndarray]:
    """Pieces ``(n, parts, d)`` of a column of equally long vectors."""
    if not len(column):
        return
    width = len(column[0])
    step = max(1, min(BLOCK // width, BLOCK // ENTRIES))
    for k in range(0, len(column), step):
        flat = column.slice(k, step).flatten().to_numpy(zero_copy_only=False)
        yield integers(flat, width // parts).reshape(-1, parts, width // parts)


def proper(vector: Column) -> Column:
    """Whether a vector has components, all of them finite."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, odd), F.lit(False))


def least_vectors(vectors: DataFrame, id_column: str, column: str, n: int) -> np.ndarray:
    """The vectors ``(n, width)`` of the ``n`` least ids, ascending; a vector an id, all as long as the first."""
    some = vectors.where(F.col(f"`{id_column}`").isNotNull() & (F.size(f"`{column}`") % PARTS == 0))
    some = some.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{column}`").alias("v"))
    first = some.orderBy("id", "v").select(F.size("v").alias("width")).first()
    if first is None:
        return np.zeros((0, 0))
    some = some.where(F.size("v") == first["width"])
    last = some.groupBy("id").agg(F.lit(1)).orderBy("id").limit(n).agg(F.max("id")).first()[0]  # ids alone are shuffled
    found = some.where(F.col("id") <= F.lit(last)).groupBy("id").agg(F.min("v").alias("v")).orderBy("id").collect()
    return np.array([r["v"] for r in found], np.float64).reshape(len(found), first["width"])


def refined(vectors: DataFrame, column: str, books: np.ndarray) -> np.ndarray:
    """Codebooks after one round: entries become the floor of their parts' means, unused ones stay."""
    parts, entries, d = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, d), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for block in blocks(batch.column(0), parts):
                codes, _ = encode(block, books)
                for p in range(parts):
                    np.add.at(total[p], codes[:, p], block[:, p])
                    count[p] += np.bincount(codes[:, p], minlength=entries)
        p, e = np.nonzero(count)
        at = np.repeat(p * entries + e, d) * d + np.tile(np.arange(d), len(p))
        yield pa.record_batch({"at": at.astype(np.int64), "total": total.ravel()[at], "n": np.repeat(count[p, e], d)})

    partial = vectors.select(F.col(f"`{column}`")).mapInArrow(sums, "at long, total long, n long")
    found = partial.groupBy("at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()
    out = books.copy().ravel()
    out[found["at"].to_numpy()] = found["total"].to_numpy() // found["n"].to_numpy()
    return out.reshape(books.shape)


def codebooks(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks ``(parts, entries, d)`` of the proper vectors of one length; empty without vectors."""
    seeds = least_vectors(vectors.where(proper(F.col(f"`{column}`"))), id_column, column, entries)
    if not seeds.size:
        return np.zeros((PARTS, 0, 0), np.int64)
    d = seeds.shape[1] // PARTS
    books = np.ascontiguousarray(integers(seeds, d).reshape(-1, PARTS, d).transpose(1, 0, 2))
    kept = fitting(vectors, column, books)
    for _ in range(rounds):
        books = refined(kept, column, books)
    return books


def fitting(vectors: DataFrame, column: str, books: np.ndarray) -> DataFrame:
    """The rows whose vectors the codebooks can encode."""
    return vectors.where((F.size(f"`{column}`") == books.shape[0] * books.shape[2]) & proper(F.col(f"`{column}`")))


def encoded(vectors: DataFrame, books: np.ndarray, column: str = "embedding") -> DataFrame:
    """The encodable rows with ``code`` (two hex digits a part) and ``error``."""
    parts = books.shape[0]
    digits = np.array([f"{i:02x}" for i in range(max(books.shape[1], 1))])

    @F.arrow_udf(T.StructType([T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))
    def of(column: pa.Array) -> pa.Array:
        codes, errors = [], []
        for block in blocks(column, parts):
            found, far = encode(block, books)
            codes += ["".join(x) for x in digits[found]]
            errors.append(far.sum(1))
        return pa.StructArray.from_arrays([pa.array(codes, pa.string()), pa.array(np.concatenate(errors) if errors else np.zeros(0, np.int64))], ["code", "error"])

    kept = [F.col(f"`{c}`") for c in vectors.columns if c.lower() not in ("code", "error")]
    name = fresh(vectors, "_encoded")
    return fitting(vectors, column, books).select(*kept, of(F.col(f"`{column}`")).alias(name)).select(*kept, f"{name}.code", f"{name}.error")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", label: str = "label") -> DataFrame:
    """``vectors`` without their vector, with ``code``, ``error``, ``label_error`` and ``codebooks_sha256``."""
    books = codebooks(vectors, id_column, column)
    path = scratch(vectors.sparkSession, "codes")
    encoded(vectors, books, column).drop(column).write.parquet(path)
    rows = vectors.sparkSession.read.parquet(path)
    sums = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    named, mine = fresh(rows, "label_error"), fresh(rows, "_label")
    by_label = rows.groupBy(F.col(f"`{label}`").alias(mine)).agg(sums.alias(named))
    by_label_path = scratch(vectors.sparkSession, "label-errors")
    by_label.write.parquet(by_label_path)
    by_label = broadcast_if_small(vectors.sparkSession.read.parquet(by_label_path))
    kept = [F.col(f"`{c}`") for c in rows.columns if c.lower() not in ("label_error", "codebooks_sha256")]
    joined = rows.join(by_label, F.col(f"`{label}`").eqNullSafe(F.col(mine)))
    return joined.select(*kept, F.col(named).alias("label_error"), F.lit(digest(books)).alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kept vector's code and errors."""
    return compress(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _round(k: int) -> str:
    """SQL of the assignment by codebook ``b{k}`` and the codebook after it."""
    return f"""
a{k} AS (SELECT row_id, part, arg_min(entry, d * 64 + entry) AS entry, min(d) AS d FROM (
    SELECT v.row_id, v.part, b.entry, list_sum(list_transform(range(1, len(v.xs) + 1), lambda i: (v.xs[i] - b.xs[i]) * (v.xs[i] - b.xs[i])))::BIGINT AS d
    FROM pieces v JOIN b{k} b ON v.part = b.part) GROUP BY row_id, part)"""


def _next(k: int) -> str:
    return f"""
m{k} AS (SELECT part, entry, pos, floor(sum(x) / count(*))::BIGINT AS x FROM (
    SELECT v.part, a.entry, unnest(range(1, len(v.xs) + 1)) AS pos, unnest(v.xs) AS x FROM pieces v JOIN a{k} a ON v.row_id = a.row_id AND v.part = a.part) GROUP BY part, entry, pos),
b{k + 1} AS (SELECT b.part, b.entry, coalesce(m.xs, b.xs) AS xs FROM b{k} b LEFT JOIN (SELECT part, entry, list(x ORDER BY pos) AS xs FROM m{k} GROUP BY part, entry) m ON b.part = m.part AND b.entry = m.entry)"""


#: The same result in DuckDB, by brute force over all pairs of part and entry.
SQL = f"""
WITH rows AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id) AS row_id, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS xs FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pieces AS MATERIALIZED (SELECT row_id, part, xs[part * len(xs) // 16 + 1 : (part + 1) * len(xs) // 16] AS xs FROM rows, range(16) r(part)),
b0 AS (SELECT part, row_id - 1 AS entry, xs FROM pieces WHERE row_id <= 64),{_round(0)},{_next(0)},{_round(1)},{_next(1)},{_round(2)},
codes AS (SELECT row_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY row_id),
book AS (SELECT sha256(string_agg(array_to_string(xs, ','), ',' ORDER BY part, entry)) AS h FROM b2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT h FROM book) AS codebooks_sha256
FROM rows JOIN codes USING (row_id)
"""
