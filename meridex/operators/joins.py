"""Checked enrichment joins and lookups."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import cut


def assert_unique(df: DataFrame, keys: list[str]) -> None:
    """Raises if a key repeats; looks at one offender."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{keys} repeat: {twice[0].asDict()}")


def enrich(left: DataFrame, dim: DataFrame, on: list[str], check: bool = True) -> DataFrame:
    """Left many-to-one join; the dimension's key must be unique. Spark broadcasts it only if its size allows."""
    if check:
        assert_unique(dim, on)
    return left.join(dim, on, "left")


def enrich_inner(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """One-to-one inner join: the key must be unique on both sides."""
    assert_unique(left, on)
    assert_unique(right, on)
    return left.join(right, on)


def unmatched(left: DataFrame, dim: DataFrame, on: list[str]) -> DataFrame:
    return left.join(dim, on, "left_anti")


#: So many aliases are tried on each text as they are, and so many keys of an index where the text stands; more by a join.
INLINE_ALIASES, INLINE_KEYS = 64, 2_000
_GRAM = 4


def alias_lookup(df: DataFrame, key: str, text: Column, directory: DataFrame, alias: str, priority: str, code: str) -> DataFrame:
    """(key, code): the first directory alias that each text contains, by priority and then by alias.

    An index on runs of four characters: a text that contains an alias has all its runs, so each alias is filed under the
    one that fewest aliases have (a shorter alias under itself). Distinct runs of texts meet the index by equal keys, and
    only texts and aliases that met are compared. An index of at most `INLINE_KEYS` keys prunes runs before they become
    rows; up to `INLINE_ALIASES` aliases need none. Directories of any size work; null and empty texts and aliases match
    nothing.
    """
    known = directory.where(F.length(alias) > 0).select(F.col(alias).alias("_alias"), F.col(priority).alias("_priority"), F.col(code).alias("_code"))
    rows = df.select(key, text.alias("_t")).where(F.length("_t") > 0)
    few = known.limit(INLINE_ALIASES + 1).collect()
    if len(few) <= INLINE_ALIASES:
        found = F.array(*[F.when(F.contains("_t", F.lit(r._alias)), F.struct(F.lit(r._priority).alias("p"), F.lit(r._alias).alias("a"), F.lit(r._code).alias("c"))) for r in few]) if few else F.array()
        met = rows.select(key, (F.array_min(F.array_compact(found)) if few else F.lit(None).cast("struct<c:string>")).alias("_m"))
        return met.where("_m is not null").groupBy(key).agg(F.min("_m")["c"].alias(code))
    runs = known.select("_alias").distinct().select("_alias", F.explode(F.array_distinct(_runs(F.col("_alias"), F.least(F.length("_alias"), F.lit(_GRAM))))).alias("_k"))
    rarest = runs.join(runs.groupBy("_k").agg(F.count("*").alias("_n")), "_k").groupBy("_alias").agg(F.min(F.struct("_n", "_k"))["_k"].alias("_k"))
    index = cut(known.join(rarest, "_alias"))
    keys = [r[0] for r in index.select("_k").distinct().limit(INLINE_KEYS + 1).collect()]
    lengths = sorted({len(k) for k in keys}) if len(keys) <= INLINE_KEYS else range(1, _GRAM + 1)
    every = F.array_distinct(F.concat(*[_runs(F.col("_t"), F.lit(n)) for n in lengths])) if keys else F.array().cast("array<string>")
    if len(keys) <= INLINE_KEYS:
        met = rows.withColumn("_k", F.explode(F.array_intersect(every, F.array(*map(F.lit, keys)).cast("array<string>")))).join(F.broadcast(index), "_k")
    else:
        rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()))
        pairs = rows.select("_row", F.explode(every).alias("_k")).join(index, "_k").select("_row", "_alias", "_priority", "_code")
        met = rows.join(pairs, "_row")
    hits = met.where(F.contains("_t", "_alias"))
    return hits.groupBy(key).agg(F.min_by("_code", F.struct("_priority", "_alias")).alias(code))


def _runs(text: Column, n: Column) -> Column:
    """All runs of n characters of a text, in one pass over it."""
    return F.regexp_extract_all(text, F.concat(F.lit("(?s)(?=(.{"), n.cast("string"), F.lit("}))")), 1)


def name_match(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of names of which one contains the other; null and empty names match nothing.

    A contained name shares all its runs of three characters with the longer one, so the one that fewest names have is
    its key (a shorter name's key is the name), and the longer name is sent to each of its runs of up to three.
    """
    l, r = (d.where((F.length(c) > 0)).withColumn("_row", F.monotonically_increasing_id()) for d, c in ((left, a), (right, b)))
    runs = lambda c, n: F.expr(f"array_distinct(transform(sequence(1, greatest(length({c}) - {n} + 1, 1)), i -> substring({c}, i, {n})))")
    every = lambda c: F.array_distinct(F.concat(runs(c, 1), runs(c, 2), runs(c, 3)))

    def contained(whole: DataFrame, w: str, part: DataFrame, p: str) -> DataFrame:
        """(_whole, _part): names of `whole` that contain one of `part`."""
        sent = whole.select(F.col(w).alias("_w")).distinct().withColumn("_k", F.explode(every("_w")))
        keys = part.select(F.col(p).alias("_p")).distinct().withColumn("_k", F.explode(F.when(F.length("_p") < 3, F.array("_p")).otherwise(runs("_p", 3))))
        rarest = keys.join(sent.groupBy("_k").agg(F.count("*").alias("_n")), "_k").groupBy("_p").agg(F.min(F.struct("_n", "_k"))["_k"].alias("_k"))
        return sent.join(rarest, "_k").where(F.contains("_w", "_p")).select("_w", "_p")

    pairs = contained(l, a, r, b).union(contained(r, b, l, a).select("_p", "_w")).distinct()
    return l.join(pairs, F.col(a) == F.col("_w")).join(r.drop("_row"), F.col(b) == F.col("_p")).drop("_row", "_w", "_p")


def shortest_paths(edges: DataFrame, requests: DataFrame) -> DataFrame:
    """(request, cost, path): least cost from `source` to `target` over undirected edges (a, b, cost), and its nodes.

    Of paths of equal cost that with the fewest nodes counts, then the one whose nodes come first. Chains of nodes with
    two neighbours that no request asks for become one edge each (`_chains`), found in rounds that grow with the
    logarithm of a chain. A table keyed by (request, node) is then relaxed over the other nodes until nothing gets
    better; a round goes on only from nodes that the last one has reached in a better way, and its table is written, so
    lineage stays short. Chains are put back at the end. Costs must not be negative. No path gives nulls.
    """
    if not edges.where("cost < 0 or cost is null").isEmpty():
        raise ValueError("costs must be known and not negative")
    one = edges.where("a <> b").select(F.when(F.col("a") <= F.col("b"), F.struct("a", "b")).otherwise(F.struct(F.col("b").alias("a"), F.col("a").alias("b"))).alias("e"), "cost").groupBy("e").agg(F.min("cost").alias("cost"))
    darts = cut(one.select("e.a", "e.b", "cost").union(one.select("e.b", "e.a", "cost")))
    asked = requests.select(F.explode(F.array("source", "target")).alias("a")).distinct()
    chains = _chains(darts, asked)
    steps = chains.where("place = 0").select("a", F.col("b").alias("first"), "end", "total", "number")
    start = F.array(F.struct(F.col("source").alias("first"), F.col("source").alias("end")))
    state = cut(requests.select("request", F.col("source").alias("node"), F.lit(0.0).alias("cost"), F.lit(1).cast("long").alias("n"), start.alias("path"), F.lit(0).alias("round")))
    for number in count(1):
        last = state.where(F.col("round") == number - 1)
        if last.isEmpty():
            break
        step = last.join(steps, F.col("node") == F.col("a")).where(~F.exists("path", lambda p: p["end"] == F.col("end")))
        step = step.select("request", F.col("end").alias("node"), (F.col("cost") + F.col("total")).alias("cost"), (F.col("n") + F.col("number")).alias("n"), F.concat("path", F.array(F.struct("first", "end"))).alias("path"), F.lit(number).alias("round"))
        best = F.min(F.struct(F.round("cost", 9).alias("r"), "n", "path", "round", "cost")).alias("m")
        state = cut(state.union(step).groupBy("request", "node").agg(best).select("request", "node", "m.cost", "m.n", "m.path", "m.round"))
    found = requests.join(state.select("request", F.col("node").alias("target"), "cost", "path"), ["request", "target"])
    at = found.select("request", F.posexplode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("f"), F.slice("path", 2, F.size("path")).alias("t"))).alias("k", "s"))
    inner = at.select("request", "k", F.col("s.f.end").alias("a"), F.col("s.t.first").alias("first")).join(chains.select(F.col("from").alias("a"), "first", "place", F.col("b").alias("node")), ["a", "first"])
    nodes = inner.groupBy("request").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "place", "node"))), lambda x: x["node"]).alias("rest"))  # a path's own nodes
    whole = found.join(nodes, "request", "left").select("request", "cost", F.concat(F.array("source"), F.coalesce("rest", F.slice(F.array("source"), 1, 0))).alias("path"))
    return requests.select("request").join(whole, "request", "left")


def _chains(darts: DataFrame, asked: DataFrame) -> DataFrame:
    """Darts (a, b, cost), both directions of each edge, with their chain: (a, b, from, first, place, end, total, number).

    A chain leads from a node through nodes with two neighbours that aren't asked for to the next other node: `from` and
    `first` name it, `place` is the dart's number in it, `end`, `total` and `number` are its last node, cost and darts.
    Pointers are doubled in each round, so rounds grow with the logarithm of the longest chain. Circles that nothing
    leads to drop out, and so do chains that come back to where they began.
    """
    inner = darts.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b1"), F.max("b").alias("b2")).where("n = 2").join(asked, "a", "left_anti")
    through = inner.select(F.col("a").alias("b"), "b1", "b2")
    state = darts.join(through, "b", "left").select("a", "b", F.when(F.col("b1").isNotNull(), F.col("b")).alias("na"), F.when(F.col("b1") == F.col("a"), F.col("b2")).otherwise(F.col("b1")).alias("nb"), F.col("b").alias("end"), F.col("a").alias("ea"), F.col("cost").alias("total"), F.lit(1).cast("long").alias("number"))
    state, most = cut(state), None
    for turn in count():
        open_ = state.where("na is not null").count()
        most = open_ if most is None else most
        if not open_ or (1 << turn) > most:
            break
        on = state.select(F.col("a").alias("na"), F.col("b").alias("nb"), *[F.col(c).alias(f"_{c}") for c in ("na", "nb", "end", "ea", "total", "number")])
        moved = state.where("na is not null").join(on, ["na", "nb"]).select("a", "b", F.col("_na").alias("na"), F.col("_nb").alias("nb"), F.col("_end").alias("end"), F.col("_ea").alias("ea"), (F.col("total") + F.col("_total")).alias("total"), (F.col("number") + F.col("_number")).alias("number"))
        state = cut(state.where("na is null").union(moved))
    known = state.where("na is null")
    # the chain of a dart begins where that of its other direction ends
    back = known.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("end").alias("from"), F.col("ea").alias("first"), (F.col("number") - 1).alias("place"))
    both = known.join(back, ["a", "b"]).where(F.col("from") != F.col("end"))
    return cut(both.select("a", "b", "from", "first", "place", "end", "total", "number"))


def section_path(edges: DataFrame, sections: DataFrame) -> DataFrame:
    """(section, cost, path): the part of a road between two boundary streets, as nodes.

    `edges`: (road, a, b, cost), undirected. `sections`: (section, road, from_street, to_street). A boundary's nodes are
    those that its street shares with the road. Of all ways between a node of one and a node of the other boundary the
    cheapest along the road counts; null where a boundary doesn't touch the road or nothing connects them.
    """
    ends = edges.select("road", F.explode(F.array("a", "b")).alias("node")).distinct()
    touch = lambda street, name: sections.select("section", "road", F.col(street).alias("_s")).join(ends, "road").join(ends.withColumnRenamed("road", "_s"), ["_s", "node"]).select("section", F.col("node").alias(name))
    asked = touch("from_street", "source").join(touch("to_street", "target"), "section").join(sections.select("section", "road"), "section")
    named = asked.withColumn("request", F.struct("section", "source", "target"))
    at = lambda c: F.struct("road", F.col(c).alias("node"))
    own = edges.join(asked.select("road").distinct(), "road", "left_semi").select(at("a").alias("a"), at("b").alias("b"), "cost")
    found = shortest_paths(own, named.select("request", at("source").alias("source"), at("target").alias("target"))).where("cost is not null")
    best = found.groupBy(F.col("request.section").alias("section")).agg(F.min(F.struct(F.round("cost", 9).alias("r"), F.size("path"), F.col("path.node").alias("path"), "cost")).alias("m"))
    return sections.select("section").join(best, "section", "left").select("section", "m.cost", "m.path")
