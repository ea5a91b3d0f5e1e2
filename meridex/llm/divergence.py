"""Source divergence audit (operator 12): how far the sources of a language are from each other, and in which terms.

Terms are runs of letters and bytes from 0x80, A-Z lower-cased. A language keeps the V terms that occur in at least
`LEAST_DOCS` of its rows. A group (language, source) or a language gives a kept term p = 1 + floor(10^9 * (count + 2) /
(N + 2 * V)), N being its occurrences of kept terms. Two of them differ in a term by floor((p - q)^2 / (p + q)).

1. Tasks count terms of their rows exactly (as strings, no hashes), merge the counts of many rows, and Spark adds them.
2. `pair`: terms are dealt in blocks of about `BLOCK_TERMS`, sources in blocks of about `BLOCK_SOURCES`. A unit is one
   block of terms with two blocks of sources, a matrix of bounded size; it gives its part of the sum of each pair. A
   term that neither source has counts too, all of these alike.
3. `term`, a dominance skyband: with p > q the difference grows with the group's count and falls with the language's,
   and equals go by their UTF-8. So a term that `k` others dominate (group's count no lower, language's count no
   higher, earlier in UTF-8) is not among the first k. Parts of a group's terms retain those that fewer than k others
   of the part dominate; up to `MERGED_PARTS` retained parts are merged and thinned again; the rest is ranked exactly.

All arithmetic is on integers. It is exact while a language has fewer than 9 * 10^15 occurrences; beyond that Spark
raises. Defined results: null text, language and source are empty ones; every row is a document of its own, repeated or
not; a group without kept terms still has its pairs; a language without kept terms has pairs of value 0 and no terms;
a language of one source has no pairs; an empty table has no rows; other columns play no part.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import salted, small, stored
from .textops import chunks, text_buffers, word_strings

LEAST_DOCS = 10
TOP = 10
BLOCK_TERMS = 4096
BLOCK_SOURCES = 128
MERGED_PARTS = 16
#: Counts that a task holds before it adds them up, and hands on what is left above half of that.
HELD_ROWS = 400_000


def share(count: Column, size: Column) -> Column:
    """1 + floor(10^9 * (count + 2) / size) by long division, three digits at a time."""
    quotient, rest = F.lit(0).cast("long"), count + F.lit(2)
    for _ in range(3):
        quotient = quotient * 1000 + F.call_function("div", rest * 1000, size)
        rest = (rest * 1000) % size
    return quotient + 1


def shares(counts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """`share` on arrays."""
    quotient, rest = np.zeros_like(counts), counts + 2
    for _ in range(3):
        rest = rest * 1000
        quotient, rest = quotient * 1000 + rest // size, rest % size
    return quotient + 1


def difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def count_terms(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", held_rows: int = HELD_ROWS) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and rows of each term; a null term for each group."""
    df = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def of_batch(batch: pa.RecordBatch) -> pa.Table:
        groups = [batch.column(c).dictionary_encode() for c in ("lang", "source")]
        group = groups[0].indices.to_numpy().astype(np.int64) * len(groups[1].dictionary) + groups[1].indices.to_numpy()
        found, before = word_strings(*text_buffers(batch.column("text")), digits=False)
        coded = found.dictionary_encode()
        wide = max(len(coded.dictionary), 1)
        owner = np.repeat(np.arange(batch.num_rows), np.diff(before))
        in_doc, times = np.unique(owner * wide + coded.indices.to_numpy(), return_counts=True)
        key, at, docs = np.unique(group[in_doc // wide] * wide + in_doc % wide, return_inverse=True, return_counts=True)
        n = np.zeros(len(key), np.int64)
        np.add.at(n, at, times)
        seen = np.unique(group)
        group = np.concatenate([key // wide, seen])
        term = pa.concat_arrays([coded.dictionary.take(pa.array(key % wide)).cast(pa.string()), pa.nulls(len(seen), pa.string())])
        none = np.zeros(len(seen), np.int64)
        names = [groups[0].dictionary.take(pa.array(group // len(groups[1].dictionary))), groups[1].dictionary.take(pa.array(group % len(groups[1].dictionary)))]
        return pa.Table.from_arrays([*(c.cast(pa.string()) for c in names), term, pa.array(np.append(n, none)), pa.array(np.append(docs, none))], schema=schema)

    def added(tables: list[pa.Table]) -> pa.Table:
        total = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
        return total.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(schema.names).cast(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for whole in batches:
            for batch in chunks(whole, limit=4 << 20):
                held.append(of_batch(batch))
                rows += held[-1].num_rows
                if rows > held_rows:
                    held = [added(held)]
                    rows = held[0].num_rows
                    if rows > held_rows // 2:
                        yield from held.pop().to_batches()
                        rows = 0
        if held:
            yield from added(held).to_batches()

    counted = df.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def skyband(count: np.ndarray, total: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Places, in `order`, of what fewer than `k` others dominate: count no lower, total no higher, earlier in `order`.

    Takes places in order. A Fenwick tree over the totals holds the k highest counts of what was retained; what is
    dominated k times is so by k retained ones, as dominance is transitive.
    """
    rank = np.unique(total, return_inverse=True)[1]
    tree: list[list[int]] = [[] for _ in range(int(rank.max()) + 2)] if len(rank) else []
    kept = []
    for i in order.tolist():
        c, x, above = int(count[i]), int(rank[i]) + 1, 0
        while x and above < k:
            above += len(tree[x]) - bisect_left(tree[x], c)
            x &= x - 1
        if above < k:
            kept.append(i)
            x = int(rank[i]) + 1
            while x < len(tree):
                insort(tree[x], c)
                if len(tree[x]) > k:
                    tree[x].pop(0)
                x += x & -x
    return np.array(kept, np.int64)


def retained(df: DataFrame, k: int) -> DataFrame:
    """The skyband of the terms (n, total, term) of each (lang, source, part)."""

    def run(group: pa.Table) -> pa.Table:
        order = pc.sort_indices(group.column("term")).to_numpy().astype(np.int64)
        return group.take(pa.array(skyband(group.column("n").to_numpy(), group.column("total").to_numpy(), order, k)))

    return df.groupBy("lang", "source", "part").applyInArrow(run, df.schema)


def unit_sums(unit: pa.Table) -> pa.Table:
    """Sums of differences of the pairs of sources of one unit, over the terms of its block."""
    term, source = unit.column("term"), unit.column("source")
    marks = unit.filter(pc.is_null(term))
    cells = unit.filter(pc.is_valid(term))
    size = np.maximum(marks.column("size").to_numpy(), 1)[:, None]
    side = marks.column("side").to_numpy()
    if len(side) == 0:
        return pa.table({"lang": [], "a": [], "b": [], "value": []}, pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64())]))
    names = marks.column("source").combine_chunks()
    coded = cells.column("term").combine_chunks().dictionary_encode()
    counts = np.zeros((len(names), len(coded.dictionary)), np.int64)
    counts[pc.index_in(cells.column("source"), names).to_numpy(), coded.indices.to_numpy()] = cells.column("n").to_numpy()
    p, none = shares(counts, size), shares(np.zeros_like(size), size)[:, 0]
    absent = int(marks.column("terms")[0].as_py()) - counts.shape[1]
    a, b, value = [], [], []
    across = unit.column("low")[0].as_py() != unit.column("high")[0].as_py()
    for i in range(len(names)):
        others = np.flatnonzero(side == 1) if across else np.arange(i + 1, len(names))
        if (across and side[i] == 1) or not len(others):
            continue
        q = p[others]
        got = ((p[i] - q) ** 2 // (p[i] + q)).sum(1) + absent * ((none[i] - none[others]) ** 2 // (none[i] + none[others]))
        a.append(np.full(len(others), i))
        b.append(others)
        value.append(got)
    a, b, value = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (a, b, value))
    lang = pa.array([unit.column("lang")[0].as_py()] * len(a), pa.string())
    return pa.Table.from_arrays([lang, names.take(pa.array(a)), names.take(pa.array(b)), pa.array(value)], names=["lang", "a", "b", "value"])


def pair_sums(cells: DataFrame, kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) of each pair of sources of a language, once."""
    block = F.pmod(F.xxhash64("term"), F.greatest(F.ceil(F.col("v") / BLOCK_TERMS), F.lit(1)))
    sized = groups.withColumn("side", F.pmod(F.xxhash64("source"), F.ceil(F.col("sources") / BLOCK_SOURCES)).cast("long"))
    sized = sized.withColumn("sides", F.ceil(F.col("sources") / BLOCK_SOURCES))
    langs = groups.groupBy("lang").agg(F.first("v").alias("v"))
    terms = kept.join(small(langs), "lang").groupBy("lang", block.alias("block")).agg(F.count("*").alias("terms"))
    marks = sized.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("v") / BLOCK_TERMS), F.lit(1)) - 1)))
    marks = marks.join(small(terms), ["lang", "block"], "left").select("lang", "source", "side", "sides", "size", "block", F.coalesce("terms", F.lit(0)).alias("terms"), F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("n"))
    found = salted(cells, sized, ["lang", "source"], "term", rows=100_000).select("lang", "source", "side", "sides", "size", block.alias("block"), F.lit(None).cast("long").alias("terms"), "term", "n")
    units = marks.unionByName(found).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1)))
    units = units.select("lang", "block", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), (F.col("side") > F.col("other")).cast("int").alias("side"), "source", "size", "terms", "term", "n")
    sums = units.groupBy("lang", "block", "low", "high").applyInArrow(unit_sums, "lang string, a string, b string, value long")
    return sums.groupBy("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("value").alias("value"))


def top_terms(cells: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """(lang, source, term, value) of a few terms of each group, the first `k` among them."""
    p, q = share(F.col("n"), F.col("size")), share(F.col("total"), F.col("lang_size"))
    own = salted(cells, groups.select("lang", "source", "size", "lang_size", "v"), ["lang", "source"], "term", rows=100_000).where(p > q)
    columns = ["lang", "source", "term", "n", "total", "size", "lang_size"]
    parts = F.ceil(F.col("v") / BLOCK_TERMS)
    dealt = own.select(*columns, F.pmod(F.xxhash64("term"), parts).cast("long").alias("part"))
    once = retained(dealt, k)
    merged = retained(once.withColumn("part", F.call_function("div", F.col("part"), F.lit(MERGED_PARTS).cast("long"))), k)
    return merged.select("lang", "source", "term", difference(p, q).alias("value"))


def divergence(df: DataFrame, least_docs: int = LEAST_DOCS, k: int = TOP, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): other sources (`pair`, all) and terms (`term`, the first `k`)."""
    counted = stored(count_terms(df, text, lang, source), "terms")
    terms = counted.where("term is not null")
    kept = stored(terms.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select("lang", "term", "total"), "kept")
    cells = stored(salted(terms.select("lang", "source", "term", "n"), kept, ["lang", "term"], "source", rows=100_000), "cells")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    named = counted.where("term is null").select("lang", "source")
    groups = named.join(cells.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").join(small(named.groupBy("lang").agg(F.count("*").alias("sources"))), "lang").join(small(langs), "lang", "left")
    none = F.lit(0).cast("long")
    v = F.coalesce("v", none)
    groups = stored(groups.select("lang", "source", "sources", v.alias("v"), (F.coalesce("n", none) + 2 * v).alias("size"), (F.coalesce("lang_n", none) + 2 * v).alias("lang_size")), "groups")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_sums(cells, kept, groups)
    pairs = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value")
    pairs = pairs.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value").withColumn("rank", F.row_number().over(by_value))
    first = top_terms(cells, groups, k).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    first = first.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= k)
    return pairs.unionByName(first)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sources of every language by how far they are apart, and the ten terms that set each source apart most."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = f"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from documents),
o as (select r, lang, source, unnest(w) as term from d),
kept as (select lang, term, count(*)::hugeint as total from o group by lang, term having count(distinct r) >= {LEAST_DOCS}),
langs as (select lang, count(*)::hugeint as v, sum(total)::hugeint as n from kept group by lang),
groups as (select distinct lang, source from d),
cells as (select lang, source, term, count(*)::hugeint as c from o join kept using (lang, term) group by all),
sizes as (select lang, source, coalesce(sum(c), 0)::hugeint as n from groups left join cells using (lang, source) group by all),
dense as (select s.lang, s.source, k.term, coalesce(c.c, 0) as c, 1 + 1000000000 * (coalesce(c.c, 0) + 2) // (s.n + 2 * l.v) as p,
    1 + 1000000000 * (k.total + 2) // (l.n + 2 * l.v) as q
    from sizes s join langs l using (lang) join kept k using (lang) left join cells c on c.lang = s.lang and c.source = s.source and c.term = k.term),
sums as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
    from dense a join dense b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select g.lang, g.source, 'pair' as part, h.source as item, coalesce(value, 0) as value
    from groups g join groups h on g.lang = h.lang and g.source <> h.source left join sums s on s.lang = g.lang and s.source = g.source and s.item = h.source),
own as (select lang, source, 'term' as part, term as item, (p - q) * (p - q) // (p + q) as value from dense where c > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pairs union all select * from own))
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= {TOP}"""
