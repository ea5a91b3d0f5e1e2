"""N-gram Jaccard join by prefix trees (operator 5).

Two documents link when their sets of distinct n-word shingles have a Jaccard similarity of at least `percent` / 100.
The result is each document's class: the connected component of links.

1. Documents of equal sets are one from here on.
2. Global order: by document frequency, then by hash. Blocks of documents send their sorted, distinct shingles to
   shards, which add them up and tell each block the frequencies of those that it shares with another document.
   Sets that link share one of the first |x| - ceil(t |x|) + 1 shingles of this order. Those of frequency one come
   first and match nothing, so a document that has enough of them is done; the others keep their shared shingles in
   the global order and send their first ones on as keys.
3. Star links. Each key has a leader, the document whose keys are shared most. Leaders are compared with the others of
   their keys, unless sizes or places in the order rule a link out, and linked ones form components.
4. The rest. Documents whose keys still hold several components form clusters: what keys connect. A cluster is one unit
   of work, each set being sent to it once. A cluster of more than `UNIT` sets is cut in parts, with a unit for each two
   of them, or goes by single keys, whichever sends fewer sets. Pairs exist only inside a unit, in the walk of step 5;
   what leaves it are links that join components. No link is lost, and a unit's memory is bounded.
5. Prefix tree. A unit's sets, in the global order, are a trie whose edges hold several shingles. All probes walk it
   together; each carries the overlap of the path so far, shared by all sets below, and leaves a subtree as soon as what
   either side has missed is more than a link allows (the overlap so far plus the remaining length is too small).
   Rare shingles come first, so sets that differ part after a few of them.

Defined results: null and empty texts have an empty set and are alone; a text with fewer than n words has its whole
sequence as its one shingle; a null key stays in the result with a null class; rows that repeat a key count as one
document with several texts, each of which can link it; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .packed import pack_sorted, pack_values, unpack_sorted, unpack_values
from .shared import BROADCAST_ROWS, connected_components, key_ranges, large, salted, small, stored
from .textops import chunks, distinct_per_text, mix, shingles, text_buffers, words

BLOCK_BYTES = 4 << 20
#: Shingles that one shard adds up at a time, about.
SHARD_NAMES = 2_000_000
#: Members of one leader that are compared in one go; more are spread over several tasks.
CHUNK = 500
#: Sets of one unit of the rest; a larger cluster is cut.
UNIT = 1000
#: Shingles that a walk looks up at a time.
STEP = 1 << 20


def _sets(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    _, _, hashes, before = words(*text_buffers(batch.column("text")))
    return shingles(hashes, before, n)


def prefix_length(size, percent: int):
    return size - -(-percent * size // 100) + 1


def needed(a, b, percent: int):
    """The least overlap of sets of these sizes that link."""
    return -(-percent * (a + b) // (100 + percent))


class PrefixTree:
    """A trie of sets in the global order.

    `sets`: ascending ranks of the shingles that others may share; `size`: sizes with the others; `group`: a number for
    each set. Edges end where sets part and at depths 4, 12, 28, ..., so an early difference costs few look-ups.
    """

    def __init__(self, sets: list[np.ndarray], size: np.ndarray, group: np.ndarray):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self.member = np.array(order, np.int64)
        self.size, self.group = np.asarray(size)[order], np.asarray(group)[order]
        ordered = [sets[i] for i in order]
        core = np.array([len(x) for x in ordered], np.int64)
        self.flat = np.concatenate(ordered) if ordered else np.zeros(0, np.int64)
        start = np.concatenate([[0], np.cumsum(core)])
        shared = np.zeros(len(ordered) + 1, np.int64)  # with the set before
        for i in range(1, len(ordered)):
            a, b = ordered[i - 1], ordered[i]
            short = min(len(a), len(b))
            differ = np.flatnonzero(a[:short] != b[:short])
            shared[i] = differ[0] if len(differ) else short
        rows = [(0, len(ordered), 0, 0)]  # first and last set, depth where the edge begins and ends
        children, leaves, k = [], [], 0
        while k < len(rows):
            lo, hi, _, depth = rows[k]
            inner = lo + int(np.searchsorted(-(core[lo:hi] == depth).astype(np.int64), 0)) if hi > lo else lo
            leaves.append((lo, inner))
            cut = [inner, *(inner + 1 + np.flatnonzero(shared[inner + 1 : hi] <= depth)).tolist(), hi] if inner < hi else [hi]
            children.append((len(rows), len(rows) + len(cut) - 1))
            until = 4
            while until <= depth:
                until = 2 * until + 4
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                common = int(shared[a + 1 : b].min()) if b > a + 1 else int(core[a])
                rows.append((a, b, depth, min(common, until)))
            k += 1
        lo, hi, begin, self.depth = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        self.at, self.length = start[lo] + begin, self.depth - begin
        self.child, self.leaf = np.array(children, np.int64), np.array(leaves, np.int64)
        over = lambda f, x: np.array([f(x[a:b]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]) if len(ordered) else np.zeros(1, np.int64)
        self.most, self.least, self.low, self.high = over(np.max, core), over(np.min, self.size), over(np.min, self.group), over(np.max, self.group)

    def join(self, sets: list[np.ndarray], size: np.ndarray, group: np.ndarray, percent: int, ascending: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(probe, member) of all links between sets of different groups; `ascending`: only with members of higher groups."""
        wide = 1 + max([int(self.flat.max(initial=0)), *(int(x[-1]) for x in sets if len(x))])
        keys = np.concatenate([i * wide + x for i, x in enumerate(sets)]) if sets else np.zeros(0, np.int64)
        core = np.array([len(x) for x in sets], np.int64)
        start = np.concatenate([[0], np.cumsum(core)])
        size, group = np.asarray(size), np.asarray(group)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        stack = [(np.arange(len(sets)), np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64))]
        while stack:
            probe, node, overlap = stack.pop()
            first, last = self.child[node].T
            many = last - first
            if not len(many) or not many.any():
                continue
            if many.sum() > STEP and len(probe) > 1:
                half = len(probe) // 2
                stack += [(probe[s], node[s], overlap[s]) for s in (slice(0, half), slice(half, None))]
                continue
            probe, overlap = np.repeat(probe, many), np.repeat(overlap, many)
            node = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
            need = needed(size[probe], self.least[node], percent)
            able = (self.high[node] > group[probe]) if ascending else (self.low[node] != group[probe]) | (self.high[node] != group[probe])
            able &= (core[probe] >= need) & (self.most[node] >= need)
            probe, node, overlap, need = probe[able], node[able], overlap[able], need[able]
            cut = np.searchsorted(np.cumsum(self.length[node]), np.arange(STEP, self.length[node].sum() + STEP, STEP))
            for part in np.split(np.arange(len(node)), np.unique(cut)):
                p, v, m, least = probe[part], node[part], overlap[part], need[part]
                if not len(p):
                    continue
                long = self.length[v]
                where = np.repeat(self.at[v] - (np.cumsum(long) - long), long) + np.arange(long.sum())
                wanted = np.repeat(p * wide, long) + self.flat[where]
                at = np.searchsorted(keys, wanted)
                hit = keys[np.minimum(at, len(keys) - 1)] == wanted
                ends = np.cumsum(long)
                m = m + np.add.reduceat(hit, ends - long, dtype=np.int64)
                passed = at[ends - 1] + hit[ends - 1] - start[p]
                go = (self.depth[v] - m <= self.most[v] - least) & (passed - m <= core[p] - least)
                p, v, m = p[go], v[go], m[go]
                a, b = self.leaf[v].T
                here = np.repeat(np.arange(len(v)), b - a)
                leaf = np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a) + np.arange(len(here))
                q = p[here]
                link = (m[here] >= needed(size[q], self.size[leaf], percent)) & ((self.group[leaf] > group[q]) if ascending else (self.group[leaf] != group[q]))
                left.append(q[link])
                right.append(self.member[leaf[link]])
                stack.append((p, v, m))
        return np.concatenate(left), np.concatenate(right)


def _ranked(table: pa.Table) -> list[np.ndarray]:
    """The sets of the rows as ranks in the global order of all shingles here."""
    tokens = [np.frombuffer(x, np.int64) for x in table.column("tokens").to_pylist()]
    if not tokens:
        return []
    often = np.concatenate([unpack_values(x) for x in table.column("often").to_pylist()]).astype(np.int64)
    flat, cut = np.concatenate(tokens), np.cumsum([len(x) for x in tokens])
    each, back = np.unique(flat, return_inverse=True)
    count = np.zeros(len(each), np.int64)
    count[back] = often
    rank = np.empty(len(each), np.int64)
    rank[np.lexsort((each.view(np.uint64), count))] = np.arange(len(each))
    return np.split(rank[back], cut[:-1])


def _groups(*columns: np.ndarray) -> list[np.ndarray]:
    """Row numbers of equal values in all columns."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(max(len(order) - 1, 0), bool)
    for c in columns:
        new |= np.diff(c[order]) != 0
    return np.split(order, np.flatnonzero(new) + 1) if len(order) else []


def _star_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of ids whose sets link; many pairs may share their a."""
    spark = sets.sparkSession
    pairs = stored(pairs, "pairs")
    near = F.broadcast if 2 * pairs.count() <= BROADCAST_ROWS else large  # no more leaders than pairs
    blocks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))) * 4
    number = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("parts"))
    of = F.pmod(F.xxhash64("a", "part"), F.lit(blocks)).alias("block")
    some = pairs.join(near(number), "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts"))).select("a", "part", F.col("b").alias("id"))
    probes = number.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).withColumn("id", F.col("a"))
    rows = some.union(probes).join(large(sets), "id").select(of, "a", "part", "id", "n", "tokens", "often")

    def join(table: pa.Table) -> pa.Table:
        a, part, ids, n = (table.column(c).to_numpy() for c in ("a", "part", "id", "n"))
        ranked = _ranked(table)
        left, right = [], []
        for rows in _groups(a, part):
            own, rest = rows[ids[rows] == a[rows]], rows[ids[rows] != a[rows]]
            tree = PrefixTree([ranked[i] for i in rest], n[rest], np.zeros(len(rest), np.int64))
            _, found = tree.join([ranked[i] for i in own], n[own], np.ones(len(own), np.int64), percent)
            right.append(ids[rest[np.unique(found)]])
            left.append(np.full(len(right[-1]), a[rows[0]]))
        return pa.table({"a": np.concatenate([np.zeros(0, np.int64), *left]), "b": np.concatenate([np.zeros(0, np.int64), *right])})

    return stored(rows.groupBy("block").applyInArrow(join, "a long, b long").distinct(), "links")


def _units(open_keys: DataFrame) -> DataFrame:
    """(unit, lo, hi, part, id, component): each id in every unit of two parts of its cluster, or of its keys."""
    nearest = open_keys.groupBy("k").agg(F.min("id").alias("b"))
    cluster = connected_components(open_keys.join(large(nearest), "k").select(F.col("id").alias("a"), "b"))
    named = open_keys.join(large(cluster.select("id", F.col("component").alias("cluster"))), "id", "left").withColumn("cluster", F.coalesce("cluster", "id"))
    named = stored(named.select("k", "id", "component", "cluster").distinct(), "clusters")
    parts = F.ceil(F.count("*") / UNIT)
    whole = named.select("cluster", "id").distinct().groupBy("cluster").agg(parts.alias("parts"), (F.count("*") * parts).alias("sent"))
    key = named.select("cluster", "k", "id").distinct().groupBy("cluster", "k").agg(parts.alias("parts"), (F.count("*") * parts).alias("sent"))
    by_key = key.groupBy("cluster").agg(F.sum("sent").alias("by_key"))
    less = whole.join(large(by_key), "cluster").withColumn("whole", F.col("sent") <= F.col("by_key")).select("cluster", "parts", "whole")
    rows = salted(named, stored(less, "cluster-sizes"), "cluster", "id")
    one = rows.where("whole").select(F.col("cluster").alias("unit"), F.lit(0).alias("k"), "parts", "id", "component").distinct()
    two = rows.where("not whole").drop("parts").join(large(key.select("cluster", "k", "parts")), ["cluster", "k"]).select(F.col("cluster").alias("unit"), "k", "parts", "id", "component").distinct()
    dealt = one.union(two).withColumn("part", F.pmod(F.xxhash64("id"), "parts")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return dealt.select(F.xxhash64("unit", "k").alias("unit"), F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "id", "component")


def _forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Which of the links (a, b) join what the earlier ones haven't."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[x] = y
            out.append(i)
    return out


def _rest_links(open_keys: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the components of the open keys as far as all links do."""
    spark = sets.sparkSession
    units = stored(_units(open_keys), "units")
    blocks = max(spark.sparkContext.defaultParallelism, units.count() // UNIT)
    of = F.pmod(F.xxhash64("unit", "lo", "hi"), F.lit(blocks)).alias("block")
    rows = units.join(large(sets), "id").select(of, "unit", "lo", "hi", "part", "id", "component", "n", "tokens", "often")

    def join(table: pa.Table) -> pa.Table:
        unit, lo, hi, part, ids, component, n = (table.column(c).to_numpy() for c in ("unit", "lo", "hi", "part", "id", "component", "n"))
        ranked = _ranked(table)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for rows in _groups(unit, lo, hi):
            one = lo[rows[0]] == hi[rows[0]]
            _, group, count = np.unique(component[rows], return_inverse=True, return_counts=True)
            if len(count) < 2:
                continue
            place = np.empty(len(count), np.int64)  # the largest component comes last and is never a probe in its own part
            place[np.argsort(count, kind="stable")] = np.arange(len(count))
            group = place[group]
            probes = np.flatnonzero(group < len(count) - 1) if one else np.flatnonzero(part[rows] == lo[rows[0]])
            among = np.arange(len(rows)) if one else np.flatnonzero(part[rows] == hi[rows[0]])
            pick = lambda x: [ranked[i] for i in rows[x]]
            tree = PrefixTree(pick(among), n[rows[among]], group[among])
            x, y = tree.join(pick(probes), n[rows[probes]], group[probes], percent, one)
            x, y = rows[probes[x]], rows[among[y]]
            keep = _forest(component[x], component[y])
            left.append(ids[x[keep]])
            right.append(ids[y[keep]])
        return pa.table({"a": np.concatenate(left), "b": np.concatenate(right)})

    return stored(rows.groupBy("block").applyInArrow(join, "a long, b long"), "more-links")


def _ordered_sets(docs: DataFrame, total_bytes: int, total: int, n: int, percent: int) -> DataFrame:
    """(id, n, core, keys, tokens, often) of each document that may link with another one.

    tokens, often: its shingles that another one may share, in global order, and their frequencies; core: their number,
    which bounds every overlap; keys: those in the prefix.
    """
    spark = docs.sparkSession
    cuts = spark.sparkContext.broadcast(key_ranges(docs, total_bytes, BLOCK_BYTES))
    bits = min(60, max(total, 1).bit_length() + 10)
    shards = max(spark.sparkContext.defaultParallelism, total // SHARD_NAMES + 1)
    cut_off = np.uint64(64 - bits)

    def block_of(keys: pa.Array) -> np.ndarray:
        return np.searchsorted(cuts.value, keys.to_numpy(), "left")

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for b, parts in held.items():
                values = np.sort(np.concatenate(parts))
                keep = np.ones(len(values), bool)
                keep[2:] = values[2:] != values[:-2]  # two of each say as much as thousands
                values = values[keep]
                shard = (values >> np.uint64(max(bits - 30, 0))).astype(np.int64) * shards >> min(bits, 30)
                edge = np.searchsorted(shard, np.arange(shards + 1))
                rows = [(s, pack_sorted(values[x:y])) for s, (x, y) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if y > x]
                s, p = zip(*rows, strict=True) if rows else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array([b] * len(s), pa.int64()), pa.array(p, pa.binary())], names=["shard", "block", "packed"])
            held.clear()

        count = 0
        for whole in batches:
            for batch in chunks(whole):
                values, starts = distinct_per_text(*_sets(batch, n))
                block = np.repeat(block_of(batch.column("key")), np.diff(starts))
                for b in np.unique(block).tolist():
                    held.setdefault(b, []).append(values[block == b] >> cut_off)
                count += len(values)
                if count > 2_000_000:
                    yield from flush()
                    count = 0
        yield from flush()

    def add_up(table: pa.Table) -> pa.Table:
        parts = [unpack_sorted(p) for p in table.column("packed").to_pylist()]
        block = np.repeat(table.column("block").to_numpy(), [len(p) for p in parts])
        every, back, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        rows = []
        order = np.lexsort((back, block))
        order = order[count[back[order]] > 1]
        edge = np.flatnonzero(np.diff(block[order])) + 1
        for part in np.split(order, edge) if len(order) else []:
            which = np.unique(back[part])
            rows.append((int(block[part[0]]), pack_sorted(every[which]), pack_values(count[which].astype(np.uint64))))
        b, p, c = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table({"block": pa.array(b, pa.int64()), "packed": pa.array(p, pa.binary()), "counts": pa.array(c, pa.binary())})

    def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(block_of(b.column("key")), pa.int64()), b.column("key"), b.column("text")], names=["block", "key", "text"])

    def first(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            known = np.concatenate([unpack_sorted(p) for p in right.column("packed").to_pylist()])
            count = np.concatenate([unpack_values(p) for p in right.column("counts").to_pylist()])
            order = np.argsort(known, kind="stable")
            known, count = known[order], count[order]
            for batch in (b for whole in left.combine_chunks().to_batches() for b in chunks(whole)):
                values, starts = distinct_per_text(*_sets(batch, n))
                at = np.minimum(np.searchsorted(known, values >> cut_off), len(known) - 1)
                often = np.where(known[at] == values >> cut_off, count[at], np.uint64(1))
                for key, x, y in zip(batch.column("key").to_pylist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    more = np.flatnonzero(often[x:y] > 1)
                    take = prefix_length(y - x, percent) - (y - x - len(more)) if y > x else 0
                    if take > 0:
                        v, c = values[x:y][more], often[x:y][more]
                        order = np.lexsort((v, c))
                        v = v[order].view(np.int64)
                        out.append((key, y - x, len(more), v[:take], v.tobytes(), pack_values(c[order])))
        return pa.table({f.name: pa.array([x[i] for x in out], f.type) for i, f in enumerate(ordered)})

    ordered = [pa.field("id", pa.int64()), pa.field("n", pa.int64()), pa.field("core", pa.int64()), pa.field("keys", pa.list_(pa.int64())), pa.field("tokens", pa.binary()), pa.field("often", pa.binary())]
    told = docs.mapInArrow(names, "shard long, block long, packed binary").groupBy("shard").applyInArrow(add_up, "block long, packed binary, counts binary")
    blocks = docs.mapInArrow(by_block, "block long, key long, text string")
    return stored(blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(first, "id long, n long, core long, keys array<long>, tokens binary, often binary"), "ordered-sets")


def classes(df: DataFrame, n: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id) for each row of `df`; keys must be integers."""
    spark = df.sparkSession
    docs = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                values, starts = distinct_per_text(*_sets(batch, n))
                sums = np.zeros((2, len(values) + 1), np.uint64)
                np.cumsum(mix(values), out=sums[0, 1:])
                np.cumsum(mix(values ^ np.uint64(0xA5A5A5A55A5A5A5A)), out=sums[1, 1:])
                whole_set = (sums[:, starts[1:]] - sums[:, starts[:-1]]).view(np.int64)
                bytes_ = np.diff(text_buffers(batch.column("text"))[1])
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(np.diff(starts), pa.int64()), pa.array(whole_set[0]), pa.array(whole_set[1]), pa.array(bytes_)], names=["key", "n", "s1", "s2", "bytes"])

    seen = stored(docs.mapInArrow(measure, "key long, n long, s1 long, s2 long, bytes long"), "sets-seen")
    real = seen.where("n > 0 and key is not null")
    groups = stored(real.groupBy("n", "s1", "s2").agg(F.min("key").alias("id")), "groups")
    # a document of several texts joins their groups
    twins = real.groupBy("key").agg(F.min(F.struct("n", "s1", "s2")).alias("x"), F.max(F.struct("n", "s1", "s2")).alias("y")).where("x <> y").select("key")
    twins = small(twins)
    copies = real.join(large(groups), ["n", "s1", "s2"]).where("key <> id").select("key").distinct().join(twins, "key", "left_anti")
    alone = docs.where("key is not null").join(small(copies), "key", "left_anti")
    totals = seen.agg(F.sum("bytes"), F.sum("n")).first()
    sets = _ordered_sets(alone, totals[0] or 0, totals[1] or 0, n, percent)
    tokens = sets.select("id", "n", "core", F.posexplode("keys").alias("at", "k"))
    shared = tokens.groupBy("k").agg(F.count("*").alias("c")).where("c > 1")
    tokens = stored(tokens.join(large(shared), "k"), "shared-keys")  # only keys of two or more sets
    weighed = tokens.join(large(tokens.groupBy("id").agg(F.avg("c").alias("w"))), "id").withColumn("down", -F.col("id"))
    leader = weighed.groupBy("k").agg(F.max(F.struct("w", "down", "n", "core", "at")).alias("l"))
    leader = leader.select("k", (-F.col("l.down")).alias("a"), F.col("l.n").alias("an"), F.col("l.core").alias("acore"), F.col("l.at").alias("aat"))
    # two sets share no more than what follows the first shingle that they share
    fits = f"100 * least(n, an) >= {percent} * greatest(n, an) and {100 + percent} * least(core - at, acore - aat) >= {percent} * (n + an)"
    found = _star_links(tokens.join(large(leader), "k").where(f"id <> a and {fits}").select("a", F.col("id").alias("b")).distinct(), sets, percent)
    again = real.join(twins, "key", "left_semi").join(large(groups), ["n", "s1", "s2"]).select(F.col("key").alias("a"), F.col("id").alias("b")).where("a <> b")
    found = found.union(again)
    component = stored(connected_components(found), "components")

    labelled = tokens.join(small(component), "id", "left").select("k", "id", F.coalesce("component", "id").alias("component"))
    mixed = labelled.groupBy("k").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("k")
    more = _rest_links(stored(labelled.join(large(mixed), "k"), "open-keys"), sets, percent)
    if not more.isEmpty():
        component = stored(connected_components(found.union(more)), "components")
    whole = groups.join(small(component), "id", "left").select("n", "s1", "s2", F.coalesce("component", "id").alias("component"))
    out = seen.join(large(whole), ["n", "s1", "s2"], "left")
    own = F.when(F.col("key").isNotNull(), F.coalesce("component", "key"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"))


def op5_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class over three-word shingles at a similarity of 0.9."""
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, percent=90)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of documents that link over five-word shingles at 0.8, the one of the smallest id stays."""
    gone = classes(docs).where("doc_id <> component_id").select("doc_id").distinct()
    stay = docs.join(small(gone), "doc_id", "left_anti")
    if not docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").isEmpty():  # repeated rows
        nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
        stay = stay.withColumn("__nth", nth).where("__nth = 1 or doc_id is null").drop("__nth")
    return stay.select(docs.columns)


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(w[i:i + 2], ' '))) END AS g FROM w
), e AS (
  SELECT doc_id, len(g) AS n, unnest(g) AS k FROM s
), link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.k = b.k AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 190 * count(*) >= 90 * (a.n + b.n)
), both_ways AS (
  SELECT a, b FROM link UNION SELECT b, a FROM link
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.other
)
SELECT s.doc_id, len(any_value(g)) AS n_shingles, min(other) AS component_id FROM s JOIN reach USING (doc_id) GROUP BY s.doc_id
"""
