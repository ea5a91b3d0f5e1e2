"""Removing repeated byte strings by a distributed difference cover (operator 8).

A byte goes if a string of `width` bytes that covers it also starts earlier: in a document of smaller key, or in the
same one further left. A full suffix array would order suffixes far beyond the bytes that matter here, so order is
only kept to depth `width`, which makes the recursion of the difference-cover construction unnecessary:

1. Sample. Positions whose place modulo 57 is in a perfect difference set of 8 residues are named by their next
   `width` - 56 bytes. For any two positions there is one offset below 57 at which both are sampled, so two equal
   strings of `width` bytes hold two samples of equal names at the same offset.
2. Names are sorted in shards; those that occur once are dropped.
3. Merge. Only strings that hold a repeated name can be repeated. Samples with a repeated name get longer names, of
   `width` + 56 bytes, which cover 57 strings each: inside a repeated passage these cover every string, since samples
   at the right offset recur every 57 bytes. What they leave, the first occurrences and the ends of passages, gets
   names of all `width` bytes, wide enough that no two strings are expected to share one. Both kinds of names are
   sorted in shards, equal neighbours compared, and all but the first block with a name are told so.
4. Each block of documents marks the strings it was told about and those that it repeats itself.

Whole texts that equal one of a smaller key go beforehand; so a group of copies is worked on once.
Blocks are ranges of keys of about `BLOCK_BYTES` of text, so the first block holds the first occurrence. Sorted names
travel as differences. At most two equal names leave a block, so a very common string stays small everywhere.

Defined results: a null text is empty; texts shorter than `width` stay whole; rows that repeat a key are ordered by
their text and count as documents of their own, null keys first; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packed import pack_sorted, unpack_sorted
from .shared import key_ranges, small
from .textops import chunks, prefix_sums, text_buffers, window_hash

WIDTH = 100
MODULUS = 57
RESIDUES = (0, 1, 3, 13, 32, 36, 43, 52)
BLOCK_BYTES = 4 << 20
#: Names that one shard sorts at a time.
SHARD_NAMES = 2_000_000
_COVER = np.zeros(MODULUS, bool)
_COVER[list(RESIDUES)] = True


def member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of `values` are in the sorted `among`; most are ruled out by a table of their upper bits."""
    out = np.zeros(len(values), bool)
    if not len(among):
        return out
    top = max(int(among[-1]).bit_length() - 22, 0)
    table = np.zeros(1 << 22, bool)
    table[(among >> np.uint64(top)).astype(np.int64)] = True
    high = (values >> np.uint64(top)).astype(np.int64)
    at = np.flatnonzero(table[np.minimum(high, (1 << 22) - 1)] & (high < 1 << 22))
    where = np.minimum(np.searchsorted(among, values[at]), len(among) - 1)
    out[at[among[where] == values[at]]] = True
    return out


def sampled(offsets: np.ndarray, need: int) -> np.ndarray:
    """Positions in the cover, counted from each text's start, with `need` bytes left in the text."""
    size = np.diff(offsets)
    within = np.arange(offsets[-1]) - np.repeat(offsets[:-1], size)
    left = np.repeat(offsets[1:], size) - np.arange(offsets[-1])
    return np.flatnonzero(_COVER[within % MODULUS] & (left >= need))


def names_at(sums: np.ndarray, at: np.ndarray, size: int, bits: int) -> np.ndarray:
    return window_hash(sums, at, at + size) >> np.uint64(64 - bits)


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes; a run ends with its text."""
    edge = np.zeros(len(mask) + 1, np.int8)
    edge[:-1] += mask
    edge[1:] -= mask
    begin, end = set(np.flatnonzero(edge > 0).tolist()), set(np.flatnonzero(edge < 0).tolist())
    for cut in offsets[1:-1].tolist():
        if 0 < cut < len(mask) and mask[cut - 1] and mask[cut]:
            begin.add(cut)
            end.add(cut)
    return np.array(sorted(begin), np.int64), np.array(sorted(end), np.int64)


def cover(starts: np.ndarray, width: int, total: int) -> np.ndarray:
    """Bytes covered by the strings that start at `starts`."""
    edge = np.zeros(total + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge[:-1]) > 0


def _ordered(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A block in the order of its documents, and their bytes and offsets."""
    order = pc.sort_indices(table, sort_keys=[("key", "ascending"), ("text", "ascending"), ("n_bytes", "ascending")], null_placement="at_start")
    table = table.take(order)
    return table, *text_buffers(table.column("text"))


def _spread(lo: np.ndarray, hi: np.ndarray, total: int) -> np.ndarray:
    """A mask of the positions in any of the ranges lo to hi, both included."""
    edge = np.zeros(total + 1, np.int32)
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi + 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _ranges(mask: np.ndarray) -> bytes:
    """The edges of the true runs of a mask, packed."""
    return pack_sorted(np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))).astype(np.uint64))


def _mask(packed: bytes, total: int) -> np.ndarray:
    edge = unpack_sorted(packed).astype(np.int64)
    return _spread(edge[::2], edge[1::2] - 1, total)


def remove_repeats(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """(key, n_bytes, kept binary, removed array<struct<start, end>>) for each row; keys must be integers."""
    if width < 2 * MODULUS - 20:
        raise ValueError(f"width must be at least {2 * MODULUS - 20}")
    spark = df.sparkSession
    size = width - MODULUS + 1
    docs = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    print_of = (F.xxhash64("text").alias("p1"), F.hash("text").alias("p2"), F.octet_length("text").cast("long").alias("n_bytes"))
    prints = docs.select("key", *print_of).where(F.col("n_bytes") >= width)
    groups = prints.groupBy("p1", "p2", "n_bytes").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last")
    copies = prints.join(small(groups), ["p1", "p2", "n_bytes"]).where("key > first").select("key", "p1", F.lit(True).alias("copy")).distinct()
    flagged = docs.select("key", "text", *print_of).join(small(copies), ["key", "p1"], "left")
    lean = flagged.select("key", F.expr("if(copy, '', text)").alias("text"), "n_bytes", F.coalesce("copy", F.lit(False)).alias("copy"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cuts = key_ranges(docs, total, BLOCK_BYTES)
    samples = max(1, total * len(RESIDUES) // MODULUS)
    name_bits = min(60, samples.bit_length() + 8)
    string_bits = 64  # what decides that two strings are equal
    shards = max(spark.sparkContext.defaultParallelism, -(-samples // SHARD_NAMES))
    edges = spark.sparkContext.broadcast(cuts)  # one number for each BLOCK_BYTES of text

    def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.searchsorted(edges.value, b.column("key").fill_null(-(1 << 63)).to_numpy(), "left")
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *(b.column(c) for c in ("key", "text", "n_bytes", "copy"))], names=["block", "key", "text", "n_bytes", "copy"])

    def split(shard_of: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        cut = np.flatnonzero(np.diff(shard_of)) + 1
        for s, part in zip(shard_of[np.concatenate([[0], cut])].tolist() if len(values) else [], np.split(values, cut), strict=False):
            yield s, part

    def of_shard(sorted_values: np.ndarray, bits: int) -> np.ndarray:
        return (sorted_values >> np.uint64(max(bits - 30, 0))).astype(np.int64) * shards >> min(bits, 30)

    def twice(values: np.ndarray) -> np.ndarray:
        """Sorted, with at most two of each."""
        values = np.sort(values)
        keep = np.ones(len(values), bool)
        keep[2:] = values[2:] != values[:-2]
        return values[keep]

    def name_samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [(s, b, pack_sorted(p)) for b, parts in held.items() if len(v := twice(np.concatenate(parts))) for s, p in split(of_shard(v, name_bits), v)]
            held.clear()
            for lo in range(0, len(rows), 2000):
                s, b, p = zip(*rows[lo : lo + 2000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(b, pa.int64()), pa.array(p, pa.binary())], names=["shard", "block", "packed"])

        count = 0
        for whole in batches:
            for batch in chunks(whole):
                data, offsets = text_buffers(batch.column("text"))
                at = sampled(offsets, size)
                names = names_at(prefix_sums(data), at, size, name_bits)
                block = np.searchsorted(edges.value, batch.column("key").fill_null(-(1 << 63)).to_numpy(), "left")
                block = np.repeat(block, np.diff(np.searchsorted(at, offsets)))
                for b in np.unique(block).tolist():
                    held.setdefault(b, []).append(names[block == b])
                count += len(names)
                if count > 4_000_000:
                    yield from flush()
                    count = 0
        yield from flush()

    def joined(table: pa.Table, kind: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All values of a shard, sorted, with their blocks."""
        parts = [unpack_sorted(p) for p in table.column("packed").to_pylist()]
        blocks = np.repeat(table.column("block").to_numpy(), [len(p) for p in parts])
        values = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        order = np.lexsort((blocks, values))
        return values[order], blocks[order]

    def told(values: np.ndarray, blocks: np.ndarray, more: list[tuple[int, int, bytes]]) -> pa.Table:
        order = np.argsort(blocks, kind="stable")
        rows = [(b, 0, pack_sorted(np.unique(p))) for b, p in split(blocks[order], values[order])] + more
        b, k, p = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table({"block": pa.array(b, pa.int64()), "kind": pa.array(k, pa.int64()), "packed": pa.array(p, pa.binary())})

    def repeated_names(table: pa.Table) -> pa.Table:
        values, blocks = joined(table)
        same = values[1:] == values[:-1]
        keep = np.append(same, False) | np.append(False, same)
        return told(values[keep], blocks[keep], [])

    def lists(table: pa.Table, kind: int) -> list[bytes]:
        return [p for k, p in zip(table.column("kind").to_pylist(), table.column("packed").to_pylist(), strict=True) if k == kind]

    def named(right: pa.Table) -> np.ndarray:
        parts = [unpack_sorted(p) for p in lists(right, 0)]
        return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)

    def named_rows(block: int, values: np.ndarray, bits: int) -> tuple[list[tuple[int, int, int, bytes]], np.ndarray]:
        """Rows for the shards of the names, and which of them the block has further left already."""
        each, first = np.unique(values, return_index=True)
        again = np.ones(len(values), bool)
        again[first] = False
        return [(s, block, 0, pack_sorted(p)) for s, p in split(of_shard(each, bits), each)], again

    def to_shards(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
        s, b, k, p = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.table({"shard": pa.array(s, pa.int64()), "block": pa.array(b, pa.int64()), "kind": pa.array(k, pa.int64()), "packed": pa.array(p, pa.binary())})

    def samples_of(data: np.ndarray, offsets: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Samples whose 57 strings lie in their text and are candidates at least in part."""
        at = sampled(offsets, width + MODULUS - 1)
        return at[candidates[at]]

    def name_passages(left: pa.Table, right: pa.Table) -> pa.Table:
        """Names of the longer strings at repeated samples; kind 1: where candidate strings start; kind 2: own repeats."""
        if not left.num_rows or not right.num_rows:
            return to_shards([])
        block = left.column("block")[0].as_py()
        _, data, offsets = _ordered(left)
        sums = prefix_sums(data)
        at = sampled(offsets, size)
        at = at[member(names_at(sums, at, size, name_bits), named(right))]
        # a string that holds the sample starts at most 56 bytes before it, and lies in its text
        text = np.searchsorted(offsets, at, "right") - 1
        lo, hi = np.maximum(at - MODULUS + 1, offsets[text]), np.minimum(at, offsets[text + 1] - width)
        candidates = _spread(lo[hi >= lo], hi[hi >= lo], len(data))
        long = samples_of(data, offsets, candidates)
        rows, again = named_rows(block, names_at(sums, long, width + MODULUS - 1, string_bits), string_bits)
        rows.append((block % shards, block, 1, _ranges(candidates)))
        if again.any():
            rows.append((block % shards, block, 2, pack_sorted(long[again].astype(np.uint64))))
        return to_shards(rows)

    def name_strings(left: pa.Table, right: pa.Table) -> pa.Table:
        """Names of the candidates that no longer string covers; kind 1: strings known to be repeats."""
        if not left.num_rows or not right.num_rows:
            return to_shards([])
        block = left.column("block")[0].as_py()
        _, data, offsets = _ordered(left)
        sums = prefix_sums(data)
        candidates = _mask(lists(right, 1)[0], len(data))
        long = samples_of(data, offsets, candidates)
        long = long[member(names_at(sums, long, width + MODULUS - 1, string_bits), named(right))]
        long = np.concatenate([long, *(unpack_sorted(p).astype(np.int64) for p in lists(right, 2))])
        covered = _spread(long, long + MODULUS - 1, len(data))
        start = np.flatnonzero(candidates & ~covered)
        rows, again = named_rows(block, names_at(sums, start, width, string_bits), string_bits)
        covered[start[again]] = True
        if covered.any():
            rows.append((block % shards, block, 1, _ranges(covered)))
        return to_shards(rows)

    def later(table: pa.Table) -> pa.Table:
        """For each block the names that an earlier block has; other kinds go on to their block."""
        mine = pc.equal(table.column("kind"), 0)
        own = table.filter(pc.invert(mine))
        values, blocks = joined(table.filter(mine))
        again = np.append(False, values[1:] == values[:-1])[: len(values)]  # blocks ascend among equal values
        return told(values[again], blocks[again], list(zip(*(own.column(c).to_pylist() for c in ("block", "kind", "packed")), strict=True)))

    def cut_out(left: pa.Table, right: pa.Table) -> pa.Table:
        table, data, offsets = _ordered(left)
        start = [np.flatnonzero(_mask(p, len(data))) for p in lists(right, 1)]
        wanted = named(right)
        if len(wanted):
            sums = prefix_sums(data)
            left_over = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
            every = np.flatnonzero(left_over >= width)
            for lo in range(0, len(every), 1 << 20):
                part = every[lo : lo + (1 << 20)]
                start.append(part[member(names_at(sums, part, width, string_bits), wanted)])
        gone = cover(np.concatenate(start), width, len(data)) if start else np.zeros(len(data), bool)
        begin, end = runs(gone, offsets)
        text = np.searchsorted(offsets, begin, "right") - 1
        copy, whole = table.column("copy").to_numpy(), table.column("n_bytes").to_numpy()
        text = np.concatenate([text, np.flatnonzero(copy)])
        begin = np.concatenate([begin - offsets[text[: len(begin)]], np.zeros(copy.sum(), np.int64)])
        end = np.concatenate([end - offsets[text[: len(end)]], whole[copy]])
        order = np.argsort(text, kind="stable")
        bounds = np.searchsorted(text[order], np.arange(len(whole) + 1)).astype(np.int32)
        spans = pa.StructArray.from_arrays([pa.array(begin[order], pa.int64()), pa.array(end[order], pa.int64())], names=["start", "end"])
        kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        return pa.table({"key": table.column("key"), "n_bytes": pa.array(whole, pa.int64()), "kept": pa.array(kept, pa.binary()), "removed": pa.ListArray.from_arrays(pa.array(bounds), spans)})

    told_schema, shard_schema = "block long, kind long, packed binary", "shard long, block long, kind long, packed binary"
    names = lean.where("not copy").select("key", "text").mapInArrow(name_samples, "shard long, block long, packed binary")
    repeated = names.groupBy("shard").applyInArrow(repeated_names, told_schema)
    blocks = lean.mapInArrow(by_block, "block long, key long, text string, n_bytes long, copy boolean")
    passages = blocks.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(name_passages, shard_schema)
    passages = passages.groupBy("shard").applyInArrow(later, told_schema)
    strings = blocks.groupBy("block").cogroup(passages.groupBy("block")).applyInArrow(name_strings, shard_schema)
    strings = strings.groupBy("shard").applyInArrow(later, told_schema)
    out = blocks.groupBy("block").cogroup(strings.groupBy("block")).applyInArrow(cut_out, "key long, n_bytes long, kept binary, removed array<struct<start:bigint,end:bigint>>")
    return out.withColumnRenamed("key", key)


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes but those that repeat a string of 100 earlier ones."""
    cut = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return cut.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), starts AS (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(generate_series(0, len(h) // 2 - 100)) AS i FROM d WHERE len(h) >= 200)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM starts) WHERE r > 1
), runs AS (
  SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM again)
), spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM runs GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans
), cut AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN cut USING (doc_id)
"""
