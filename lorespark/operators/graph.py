"""Typed page graph: building, neighbourhoods, paths, impact, cycles, exports.

Edges are ``src, dst, edge_type, provenance, seq``; pages are ``id, title,
page_type, tags, aliases, relates_to, refs`` with ``seq`` in id order.
Traversals are loops of equi-joins on the frontier with the visited set taken
out, so a round's cost follows the frontier; each round is checkpointed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..sources.store import checkpointed, stored

IMPACT = ("depends_on", "extends")
#: Characters by which names that contain each other meet.
GRAM = 6


# ---- building ----------------------------------------------------------------


def with_seq(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``seq``, each row's place from 1 in an order: places within range partitions, after the rows of those before."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    held = checkpointed(placed.select("*", F.spark_partition_id().alias("_part"), row.alias("_row")))
    # one row a partition
    sizes = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return held.join(F.broadcast(before), "_part").select(*df.columns, (F.col("_before") + F.col("_row") + 1).alias("seq"))


def numbered(pages: DataFrame) -> DataFrame:
    """Pages with ``seq``, their place in id order."""
    return with_seq(pages, "id")


def mentions(pages: DataFrame) -> DataFrame:
    """``(src, edge_type, target, ord)``: authored relations, then body references not among them."""
    own = pages.select(F.col("id").alias("src"), F.posexplode("relates_to").alias("ord", "r")).select("src", F.lower("r.type").alias("edge_type"), F.col("r.target").alias("target"), "ord")
    body = pages.select(F.col("id").alias("src"), F.posexplode("refs").alias("ord", "target")).select("src", F.lit("references").alias("edge_type"), F.concat(F.lit("wiki:"), F.replace("target", F.lit("/"), F.lit(":"))).alias("target"), (F.col("ord") + 1_000_000).alias("ord"))
    said = own.where("edge_type = 'references'").select("src", F.replace("target", F.lit("/"), F.lit(":")).alias("target"))
    return own.unionByName(body.join(said, ["src", "target"], "left_anti"))


def _plain(c: Column | str) -> Column:
    """Lower case, dashes as spaces."""
    return F.replace(F.lower(c), F.lit("-"), F.lit(" "))


def _grams(c: str) -> Column:
    """Distinct parts of a name of up to ``GRAM`` characters."""
    of_length = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(F.col(c), i, n))
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(GRAM)), of_length)))


def resolve(found: DataFrame, pages: DataFrame) -> DataFrame:
    """Edges for mentions: an exact id first, else every page that the target may mean.

    These are pages with the target as id or last part of it, as title or alias
    (dashes count as spaces), with a title that contains it or that it contains.
    The first in id order is meant; several make the edge ambiguous.  Equalities
    are equi-joins; parts meet by their first ``GRAM`` characters, so a pair is
    compared only if one name holds the other's beginning.
    """
    exact = F.replace("target", F.lit("/"), F.lit(":"))
    ids = pages.select(F.col("id").alias("_id"))
    first = found.withColumn("_exact", exact)
    direct = first.join(ids, F.col("_exact") == F.col("_id"), "left_semi")
    direct = direct.select("src", "edge_type", "ord", F.col("_exact").alias("dst"), F.lit("explicit").alias("provenance"))
    open_ = first.join(ids, F.col("_exact") == F.col("_id"), "left_anti").select("src", "edge_type", "ord", F.lower("target").alias("low"), _plain("target").alias("name")).where("name <> ''")
    keep = ["src", "edge_type", "ord", "id", "seq"]
    of_id = pages.select("id", "seq", F.explode(F.array_distinct(F.array(F.lower("id"), F.lower(F.element_at(F.split("id", ":"), -1))))).alias("low"))
    aliases = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), _plain)
    named = pages.select("id", "seq", F.explode(F.array_union(F.array(_plain("title")), aliases)).alias("name"))
    titles = pages.select("id", "seq", _plain("title").alias("title")).where("title <> ''")
    wide = open_.withColumn("gram", F.substring("name", 1, GRAM)).join(titles.select("*", F.explode(_grams("title")).alias("gram")), "gram").where(F.contains("title", "name"))
    narrow = open_.select("*", F.explode(_grams("name")).alias("gram")).join(titles.withColumn("gram", F.substring("title", 1, GRAM)), "gram").where(F.contains("name", "title"))
    meant = open_.join(of_id, "low").select(*keep)
    for more in (open_.join(named, "name"), wide, narrow):
        meant = meant.unionByName(more.select(*keep))
    one = meant.groupBy("src", "edge_type", "ord").agg(F.min_by("id", "seq").alias("dst"), F.count_distinct("id").alias("n"))
    return direct.unionByName(one.select("src", "edge_type", "ord", "dst", F.when(F.col("n") > 1, "ambiguous").otherwise("explicit").alias("provenance")))


def build_edges(pages: DataFrame, custom_types: tuple[str, ...] = ()) -> DataFrame:
    """The stored edges of ``pages``; unresolved targets and unregistered types give none."""
    known = [*scoring.EDGE_PRIORITY, *custom_types]
    found = resolve(mentions(pages).where(F.col("edge_type").isin(*known)), numbered(pages))
    return with_seq(found, "src", "ord", "dst").select("src", "dst", "edge_type", "provenance", "seq")


def unresolved(pages: DataFrame) -> DataFrame:
    """Mentions without a page."""
    found = mentions(pages)
    return found.join(resolve(found, numbered(pages)).select("src", "ord"), ["src", "ord"], "left_anti")


# ---- statistics ----------------------------------------------------------------


def degrees(edges: DataFrame) -> DataFrame:
    """In plus out degree; a self-loop counts twice."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def centrality(edges: DataFrame) -> DataFrame:
    """Inbound priority weighed by provenance."""
    weight = scoring.edge_priority("edge_type") * scoring.provenance_factor("provenance")
    return edges.groupBy(F.col("dst").alias("id")).agg(F.sum(weight).alias("centrality"))


def stats(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts by page type, beside node and edge totals."""
    by_type = pages.groupBy(F.concat(F.lit("type:"), "page_type").alias("metric")).agg(F.count(F.lit(1)).alias("value"))
    return by_type.unionByName(pages.agg(F.count(F.lit(1)).alias("value")).select(F.lit("nodes").alias("metric"), "value")).unionByName(edges.agg(F.count(F.lit(1)).alias("value")).select(F.lit("edges").alias("metric"), "value"))


def orphans(pages: DataFrame, edges: DataFrame) -> DataFrame:
    return pages.join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def undirected(edges: DataFrame) -> DataFrame:
    """Edges as seen from both ends, a self-loop once: ``(id, other, direction, ...)``."""
    out = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit("out").alias("direction"), "edge_type", "provenance", "seq")
    into = edges.where("src <> dst").select(F.col("dst").alias("id"), F.col("src").alias("other"), F.lit("in").alias("direction"), "edge_type", "provenance", "seq")
    return out.unionByName(into)


# ---- neighbourhoods --------------------------------------------------------


def neighbors(edges: DataFrame, pages: DataFrame, node: str, query: str | None = None) -> DataFrame:
    """A row for each edge at ``node``, scored by priority and the query's match of title and tags."""
    at = undirected(edges).where(F.col("id") == F.lit(node)).join(pages.select(F.col("id").alias("other"), "title", "tags", "page_type"), "other")
    score = scoring.edge_priority("edge_type").cast("double")
    if query:
        q = F.lit(query.lower())
        title = F.lower("title")
        hit = F.when(F.contains(title, q), 4.0).otherwise(0.0) + F.when(F.exists("tags", lambda t: F.contains(F.lower(t), q)), 2.2).otherwise(0.0) + F.when(title == q, 8.0).otherwise(0.0)
        score = score * (1 + hit)
    return at.select("other", "direction", "edge_type", "provenance", "title", "page_type", score.alias("score")).orderBy(F.desc("score"), "other", "edge_type")


def reach(edges: DataFrame, start: DataFrame, depth: int, source: str = "id", target: str = "other") -> DataFrame:
    """``(id, depth)`` of every node within ``depth`` steps of ``start(id)``, with its least depth."""
    links = edges.select(F.col(source).alias("_from"), F.col(target).alias("_to")).distinct()
    seen = checkpointed(start.select("id").distinct().withColumn("depth", F.lit(0)))
    for d in range(1, depth + 1):
        edge = seen.where(F.col("depth") == d - 1).join(links, F.col("id") == F.col("_from")).select(F.col("_to").alias("id")).distinct()
        new = checkpointed(edge.join(seen, "id", "left_anti").withColumn("depth", F.lit(d)))
        if new.isEmpty():
            break
        seen = checkpointed(seen.unionByName(new))
    return seen


def subgraph(edges: DataFrame, center: str, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``depth`` (at most 5) and the edges seen from each of them, so inner edges come from both ends."""
    nodes = reach(undirected(edges), edges.sparkSession.createDataFrame([(center,)], "id string"), min(depth, 5))
    return nodes, undirected(edges).join(nodes, "id", "left_semi")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes(id)``."""
    inside = nodes.select("id")
    return edges.join(inside.withColumnRenamed("id", "src"), "src", "left_semi").join(inside.withColumnRenamed("id", "dst"), "dst", "left_semi")


def _hops(links: DataFrame, start: str, depth: int, stop: str | None) -> DataFrame:
    """Breadth-first tree as ``(id, depth, hops)``; a node's parent is its first discoverer (least path, then edge order)."""
    spark = links.sparkSession
    hop = "array<struct<node:string,edge_type:string,provenance:string>>"
    seen = checkpointed(spark.createDataFrame([(start, 0)], "id string, depth int").withColumn("hops", F.array().cast(hop)).withColumn("rank", F.array().cast("array<bigint>")))
    for d in range(1, depth + 1):
        front = seen.where(F.col("depth") == d - 1)
        grown = front.withColumnRenamed("id", "_at").join(links.withColumnRenamed("id", "_at"), "_at").join(seen.select(F.col("id").alias("other")), "other", "left_anti")
        step = grown.select(F.col("other").alias("id"), F.concat("hops", F.array(F.struct(F.col("other").alias("node"), "edge_type", "provenance"))).alias("hops"), F.concat("rank", F.array(F.col("seq").cast("long"))).alias("rank"))
        new = checkpointed(step.groupBy("id").agg(F.min(F.struct("rank", "hops")).alias("m")).select("id", F.lit(d).alias("depth"), "m.hops", "m.rank"))
        if new.isEmpty():
            break
        seen = checkpointed(seen.unionByName(new))
        if stop is not None and not new.where(F.col("id") == F.lit(stop)).isEmpty():
            break
    return seen.drop("rank")


def shortest_path(edges: DataFrame, start: str, end: str, max_depth: int = 10) -> DataFrame:
    """The hops from ``start`` to ``end`` along edges in either direction; no row if there is none."""
    return _hops(undirected(edges).select("id", "other", "edge_type", "provenance", "seq"), start, max_depth, end).where(F.col("id") == F.lit(end))


def affected(edges: DataFrame, node: str, max_depth: int = 10, types: tuple[str, ...] | None = IMPACT) -> DataFrame:
    """What depends on ``node``, over inbound edges of ``types`` (None: all), each once with its hops."""
    back = edges if types is None else edges.where(F.col("edge_type").isin(*types))
    links = back.select(F.col("dst").alias("id"), F.col("src").alias("other"), "edge_type", "provenance", "seq")
    return _hops(links, node, min(max_depth, 25), None).where("depth > 0").orderBy("id")


def directed_neighbors(edges: DataFrame, node: str) -> DataFrame:
    """Out-neighbours, then in-neighbours that aren't among them."""
    out = edges.where(F.col("src") == F.lit(node)).select(F.col("dst").alias("id")).distinct().withColumn("direction", F.lit("out"))
    into = edges.where(F.col("dst") == F.lit(node)).select(F.col("src").alias("id")).distinct().join(out, "id", "left_anti").withColumn("direction", F.lit("in"))
    return out.unionByName(into)


# ---- cycles ----------------------------------------------------------------


def _peeled(edges: DataFrame) -> DataFrame:
    """Edges whose source has edges in and whose target has edges out."""
    return edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")


def cyclic_core(edges: DataFrame) -> DataFrame:
    """What remains of the edges when nodes without in- or out-edges are peeled away until nothing changes.

    The rounds follow the longest tail of a graph with cycles; one without is
    empty at once.
    """
    now = checkpointed(edges.select("src", "dst").distinct())
    if not has_cycle(now):
        return now.limit(0)
    size = now.count()
    while True:
        now = checkpointed(_peeled(now))
        left = now.count()
        if left == size:
            return now
        size = left


def _bridged(edges: DataFrame) -> DataFrame:
    """Edges after some nodes with one edge in and one out gave way to an edge past them; no two neighbours at once."""
    into = edges.groupBy(F.col("dst").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("a")).where("n = 1").drop("n")
    out = edges.groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("b")).where("n = 1").drop("n")
    single = into.join(out, "v").select("v", "a", "b", F.xxhash64("v").alias("h"))
    of = lambda x: single.select(F.col("v").alias(x), F.col("h").alias(f"h{x}"))
    least = (F.col("ha").isNull() | (F.col("h") < F.col("ha"))) & (F.col("hb").isNull() | (F.col("h") < F.col("hb")))
    gone = single.join(of("a"), "a", "left").join(of("b"), "b", "left").where(least).select("v", "a", "b")
    nodes = gone.select("v")
    stay = edges.join(nodes.withColumnRenamed("v", "src"), "src", "left_anti").join(nodes.withColumnRenamed("v", "dst"), "dst", "left_anti")
    return stay.select("src", "dst").union(gone.select("a", "b")).distinct()


def has_cycle(edges: DataFrame) -> bool:
    """Whether the edges close a cycle; chains shrink by a share every round, so their length doesn't count."""
    now, size = checkpointed(edges.select("src", "dst").distinct()), -1
    while True:
        left, loops = now.agg(F.count(F.lit(1)), F.count_if(F.col("src") == F.col("dst"))).first()
        if not left:
            return False
        # where nothing could be peeled or bridged, every node has edges in and out
        if loops or left == size:
            return True
        size, now = left, checkpointed(_bridged(checkpointed(_peeled(now))))


def _coloured(edges: DataFrame) -> DataFrame:
    """``(id, component)`` of nodes on cycles, by forward and backward colouring.

    Every node takes the largest id that reaches it; the nodes of a colour that
    reach its root backwards within the colour are a component and leave.
    """
    left = cyclic_core(edges)
    found = None
    while not left.isEmpty():
        colour = checkpointed(left.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("colour", F.col("id")))
        while True:
            pushed = left.join(colour, left["src"] == colour["id"]).select(F.col("dst").alias("id"), "colour")
            new = checkpointed(colour.unionByName(pushed).groupBy("id").agg(F.max("colour").alias("colour")))
            changed = new.join(colour, ["id", "colour"], "left_anti").limit(1).count()
            colour = new
            if not changed:
                break
        inside = left.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("c1")), "src").join(colour.select(F.col("id").alias("dst"), F.col("colour").alias("c2")), "dst").where("c1 = c2").select("src", "dst", F.col("c1").alias("colour"))
        inside = checkpointed(inside)
        members = checkpointed(colour.where("id = colour"))
        while True:
            back = inside.join(members.select(F.col("id").alias("dst"), "colour"), ["dst", "colour"]).select(F.col("src").alias("id"), "colour")
            new = back.distinct().join(members, ["id", "colour"], "left_anti")
            new = checkpointed(new)
            if new.isEmpty():
                break
            members = checkpointed(members.unionByName(new))
        part = members.select("id", F.col("colour").alias("component"))
        found = part if found is None else checkpointed(found.unionByName(part))
        gone = members.select("id")
        left = cyclic_core(left.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti"))
    if found is None:
        return edges.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0)
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return found.join(sizes.select("component"), "component", "left_semi").select("id", "component")


def _pointed(parents: DataFrame) -> DataFrame:
    """``(id, root)`` of a forest ``parents(id, up)`` without its roots; paths shrink to a quarter every round."""
    now = stored(parents.select("id", F.col("up").alias("root")), "roots")
    while True:
        over = now.select(F.col("id").alias("root"), F.col("root").alias("_over"))
        half = now.join(over, "root", "left").select("id", F.coalesce("_over", "root").alias("root"))
        over = half.select(F.col("id").alias("root"), F.col("root").alias("_over"))
        new = stored(half.join(over, "root", "left").select("id", F.coalesce("_over", "root").alias("root"), F.col("_over").isNotNull().alias("_moved")), "roots")
        now = new.select("id", "root")
        if new.where("_moved").isEmpty():
            return now


def _contracted(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Distinct edges ``(a, b)`` between the roots ``(id, root)`` of different ends; nodes that aren't in ``roots`` stay."""
    of = lambda x: roots.select(F.col("id").alias(x), F.col("root").alias(f"_{x}"))
    # many edges of a node lead to one root, so what is left after the first join is little
    half = edges.join(of("a"), "a", "left").select(F.coalesce("_a", "a").alias("a"), "b").distinct()
    both = half.join(of("b"), "b", "left").select("a", F.coalesce("_b", "b").alias("b")).where("a <> b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _hooked(edges: DataFrame, turn: int) -> DataFrame:
    """``(id, up)``: nodes of ``edges(a, b)`` beneath their neighbour of least hash where that is less than their own; no cycles."""
    mark = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("v"))
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("id"), mark("b").alias("m")), F.struct(F.col("b").alias("id"), mark("a").alias("m")))).alias("e"))
    least = ends.groupBy("e.id").agg(F.min("e.m").alias("m"))
    return least.where(F.col("m") < mark("id")).select("id", F.col("m.v").alias("up"))


def mutual_components(edges: DataFrame) -> DataFrame:
    """``(id, root)`` of the nodes that undirected ``edges(a, b)`` join, without the roots.

    Two links of every node (to its neighbours of least hash under two seeds) are
    joined first, as they are few against the edges and mostly leave few classes;
    then all edges between different classes are taken up again.  The seeds change
    every round, so at least half of what is left goes, on average, whatever the
    order of ids.
    """
    found, turn = None, 0
    left = edges
    while not left.isEmpty():
        one = stored(_hooked(left, turn).select("id", "up").union(_hooked(left, turn + 1).select("id", "up")), "hooks")
        few = stored(one.select(F.least("id", "up").alias("a"), F.greatest("id", "up").alias("b")).distinct(), "links")
        turn += 2
        roots = None
        while not few.isEmpty():
            step = _pointed(_hooked(few, turn))
            turn += 1
            roots = step if roots is None else _composed(roots, step)
            few = stored(_contracted(few, step), "links")
        found = roots if found is None else _composed(found, roots)
        left = stored(_contracted(left, roots), "left")
    return found if found is not None else edges.select(F.col("a").alias("id"), F.col("b").alias("root")).limit(0)


def _composed(roots: DataFrame, step: DataFrame) -> DataFrame:
    """``roots(id, root)`` after their roots got roots by ``step``; stored."""
    over = step.select(F.col("id").alias("root"), F.col("root").alias("_over"))
    return stored(roots.join(over, "root", "left").select("id", F.coalesce("_over", "root").alias("root")).union(step.select("id", "root")), "roots")


def strong_components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` of nodes on cycles of several nodes; a component is named by its largest id.

    Nodes with edges both ways are in one component, so these are joined first,
    by rounds that shrink the graph; only what then has one-way edges is coloured.
    """
    back = F.col("src") > F.col("dst")
    seen = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), back.alias("back"))
    ways = stored(seen.groupBy("a", "b").agg(F.bool_or("back").alias("back"), F.bool_or(~F.col("back")).alias("forth")), "ways")
    roots = mutual_components(ways.where("back and forth").select("a", "b"))
    single = ways.where("not (back and forth)")
    if not single.isEmpty():
        of = lambda x: roots.select(F.col("id").alias(x), F.col("root").alias(f"_{x}"))
        ends = single.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"), "back").where("a <> b")
        turned = lambda x, y: F.when(F.col("back"), F.col(x)).otherwise(F.col(y))
        coloured = _coloured(ends.select(turned("b", "a").alias("src"), turned("a", "b").alias("dst")).distinct())
        roots = _composed(roots, coloured.where("id <> component").select("id", F.col("component").alias("root")))
    # roots are members, too
    members = roots.select("id", "root").union(roots.select(F.col("root").alias("id"), "root").distinct())
    names = stored(roots.groupBy("root").agg(F.greatest(F.max("id"), F.col("root")).alias("component")), "names")
    return members.join(names, "root").select("id", "component")


def import_cycles(edges: DataFrame) -> DataFrame:
    """Files that import each other: a sorted, closed list for every component of static imports."""
    static = edges.where("edge_type = 'imports'").select("src", "dst")
    groups = strong_components(static).groupBy("component").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    return groups.select(F.concat("ids", F.slice("ids", 1, 1)).alias("cycle")).orderBy("cycle")


# ---- exports -----------------------------------------------------------------


def export_nodes(pages: DataFrame, edges: DataFrame) -> DataFrame:
    joined = pages.join(degrees(edges), "id", "left")
    return joined.select("id", "title", "page_type", F.coalesce("degree", F.lit(0)).alias("degree"))


def export_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("edge_type").alias("type"), "provenance", "seq")


def as_json(df: DataFrame) -> DataFrame:
    """One JSON document a row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def graphml(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """GraphML lines in order ``(section, ord, value)``: header, nodes, edges ``e0..``, footer."""
    from ..functions.text import xml_escape

    spark = pages.sparkSession
    head = spark.createDataFrame([(0, 0, '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">'), (3, 0, "</graph></graphml>")], "section int, ord long, value string")
    data = lambda key, c: F.concat(F.lit(f'<data key="{key}">'), xml_escape(c), F.lit("</data>"))
    node = F.concat(F.lit('<node id="'), xml_escape("id"), F.lit('">'), data("title", "title"), data("page_type", "page_type"), F.lit("</node>"))
    nodes = numbered(pages).select(F.lit(1).alias("section"), F.col("seq").cast("long").alias("ord"), node.alias("value"))
    n = (F.col("seq") - 1).cast("long")
    edge = F.concat(F.lit('<edge id="e'), n.cast("string"), F.lit('" source="'), xml_escape("src"), F.lit('" target="'), xml_escape("dst"), F.lit('">'), data("type", "edge_type"), data("provenance", "provenance"), F.lit("</edge>"))
    return head.unionByName(nodes).unionByName(edges.select(F.lit(2).alias("section"), n.alias("ord"), edge.alias("value"))).orderBy("section", "ord")


def vault_links(edges: DataFrame) -> DataFrame:
    """Link lines of each page's vault note, without repeats: ``(id, lines)``."""
    line = F.concat(F.lit("- [["), "dst", F.lit("]] <!-- "), "edge_type", F.lit(" / "), "provenance", F.lit(" -->"))
    distinct = edges.select("src", line.alias("line")).distinct()
    return distinct.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("line")).alias("lines"))


def index_page(pages: DataFrame) -> DataFrame:
    """Markdown list of pages by type: ``(page_type, n, section)``."""
    item = F.concat(F.lit("- ["), "title", F.lit("]("), "id", F.lit(")"))
    by = pages.groupBy("page_type").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(item)).alias("items"))
    return by.select("page_type", "n", F.concat_ws("\n", F.concat(F.lit("## "), "page_type", F.lit(" ("), F.col("n").cast("string"), F.lit(")")), "items").alias("section")).orderBy("page_type")


def filtered(pages: DataFrame, edges: DataFrame, page_type: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The whole graph, or the pages of one type and the edges that touch one."""
    if page_type is None:
        return pages, edges
    nodes = pages.where(F.col("page_type") == page_type)
    ids = nodes.select("id")
    touching: Column = F.col("_s").isNotNull() | F.col("_d").isNotNull()
    kept = edges.join(ids.withColumn("_s", F.col("id")).withColumnRenamed("id", "src"), "src", "left").join(ids.withColumn("_d", F.col("id")).withColumnRenamed("id", "dst"), "dst", "left").where(touching)
    return nodes, kept.select(*edges.columns)
