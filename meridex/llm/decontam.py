"""Benchmark decontamination (operator 10).

A document is contaminated by an item if one of its windows of as many words as the item (the whole document, if it
is shorter) has a weighted similarity of at least `SIMILARITY` with the item: over 5-word shingles, sum of the lesser
counts over sum of the greater counts.

1. A window of w shingles that similar to an item of as many shares w * 8 / 9 of them at least, counted with repeats. So
   only windows that hold so many places of shingles of one item count; nothing similar is lost.
2. Every such window gets a 64-bit SimHash, which is looked up in a multi-index of the items of that length. It cuts
   fingerprints into eight blocks of eight bits; two fingerprints within `RADIUS` = 24 bits agree in some block to 3
   bits (24 / 8). For each block and each of its 256 values a table holds the items that near, so eight look-ups give
   all fingerprints within the radius; their distance is checked. At the threshold two fingerprints differ in about 10
   bits, 24 being five standard deviations above that.
3. The exact weighted similarity decides, for pairs that have that many places in common.

Items are read in blocks of at most `ITEM_BLOCK_BYTES` of text, a proven bound for what is sent to the executors;
more items mean more passes over the documents, each written before the next. Memory of a task follows its longest text.

Defined results: null and empty texts and items match nothing; a text or item of fewer than five words has its whole
sequence as its one shingle; of equally similar windows the first is reported; repeated rows get repeated results; items
of equal keys are items of their own; a null key is reported as null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .shared import stored
from .textops import chunks, mix, shingles, text_buffers, words

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 24
BLOCKS = 8
ITEM_BLOCK_BYTES = 16 << 20
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def fingerprints(values: np.ndarray, starts: np.ndarray, wide: int, hashes: np.ndarray | None = None) -> np.ndarray:
    """SimHashes, as eight bytes each, of the windows of `wide` shingles: a bit is set where most hashes have it."""
    hashes = mix(values ^ np.uint64(0x5851F42D4C957F2D)) if hashes is None else hashes
    out = np.zeros((len(starts), 8), np.uint8)
    sums = np.zeros((len(values) + 1, 8), np.int32)
    for block in range(8):
        byte = (hashes >> np.uint64(8 * block)).astype(np.uint8)
        np.cumsum((np.unpackbits(byte[:, None], axis=1).astype(np.int32) << 1) - 1, axis=0, out=sums[1:])
        out[:, block] = np.packbits(sums[starts + wide] - sums[starts] > 0, axis=1)[:, 0] if len(starts) else 0
    return out


class BlockTables:
    """Multi-index of fingerprints: for each block and value, which of them are within RADIUS / BLOCKS bits there."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        values = np.arange(256, dtype=np.uint8)
        near = [_POP[values[:, None] ^ prints[None, :, b]] <= RADIUS // BLOCKS for b in range(BLOCKS)]
        self.tables = np.packbits(np.stack(near), axis=2)

    def within_radius(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, place) of all pairs within RADIUS."""
        some = self.tables[0][prints[:, 0]]
        for b in range(1, BLOCKS):
            some = some | self.tables[b][prints[:, b]]
        query, place = np.nonzero(np.unpackbits(some, axis=1, count=len(self.prints)))
        near = _POP[prints[query] ^ self.prints[place]].sum(1) <= RADIUS
        return query[near], place[near]


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the lesser over sum of the greater counts of two bags of hashes."""
    va, ca = np.unique(a, return_counts=True)
    vb, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    common = int(np.minimum(ca[ia], cb[ib]).sum())
    return common / max(len(a) + len(b) - common, 1)


def least_common(wide: int, bag: int) -> int:
    """Shingles that a window of `wide` must share with an item of `bag` to be similar: c / (wide + bag - c) >= SIMILARITY."""
    return max(1, math.ceil(SIMILARITY / (1 + SIMILARITY) * (wide + bag) - 1e-9))


def crowded(spot: np.ndarray, of: np.ndarray, need: int, wide: int, last: int) -> np.ndarray:
    """Starts of the windows, 0 to `last`, that hold `need` spots of one item; spots are sorted by item and place."""
    j = np.arange(len(spot) - need + 1)
    lo, hi = np.maximum(spot[j + need - 1] - wide + 1, 0), np.minimum(spot[j], last)
    held = (of[j] == of[j + need - 1]) & (lo <= hi)
    edge = np.zeros(last + 2, np.int64)
    np.add.at(edge, lo[held], 1)
    np.add.at(edge, hi[held] + 1, -1)
    return np.flatnonzero(np.cumsum(edge[:-1]) > 0)


class ItemIndex:
    """Shingles, lengths and SimHashes of a block of items."""

    def __init__(self, keys: list, texts: list[str | None]):
        data, offsets = text_buffers(pa.array(texts, pa.string()))
        _, _, hashes, before = words(data, offsets)
        values, starts = shingles(hashes, before, SHINGLE)
        count = np.diff(before)
        used = np.flatnonzero(count > 0)
        self.keys = [keys[i] for i in used]
        self.length = count[used]
        self.bag = [values[starts[i] : starts[i + 1]] for i in used]
        self.index: dict[int, tuple[np.ndarray, BlockTables]] = {}
        for length in np.unique(self.length).tolist():
            items = np.flatnonzero(self.length == length)
            prints = [fingerprints(self.bag[i], np.zeros(1, np.int64), len(self.bag[i])) for i in items]
            self.index[length] = (items, BlockTables(np.concatenate(prints)))
        owner = np.repeat(np.arange(len(used)), [len(b) for b in self.bag]) if len(used) else np.zeros(0, np.int64)
        flat = np.concatenate(self.bag) if len(used) else np.zeros(0, np.uint64)
        pairs = np.unique(np.stack([flat, owner.astype(np.uint64)], 1), axis=0) if len(flat) else np.zeros((0, 2), np.uint64)
        self.shingle, first = np.unique(pairs[:, 0], return_index=True)
        self.first = np.append(first, len(pairs))
        self.owner = pairs[:, 1].astype(np.int64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.shingle >> np.uint64(44)).astype(np.int64)] = True

    def shared(self, values: np.ndarray) -> np.ndarray:
        """Where these shingles are an item's."""
        at = np.flatnonzero(self.maybe[(values >> np.uint64(44)).astype(np.int64)])
        if not len(at) or not len(self.shingle):
            return at[:0]
        where = np.minimum(np.searchsorted(self.shingle, values[at]), len(self.shingle) - 1)
        return at[self.shingle[where] == values[at]]

    def matches(self, values: np.ndarray, hits: np.ndarray, n_words: int) -> list[tuple]:
        """(item, similarity, first word, words) of the best window for each item that contaminates the text."""
        at = np.searchsorted(self.shingle, values[hits])
        number = self.first[at + 1] - self.first[at]
        position = np.repeat(hits, number)
        owner = self.owner[np.repeat(self.first[at] - (np.cumsum(number) - number), number) + np.arange(number.sum())]
        order = np.lexsort((position, owner))
        position, owner = position[order], owner[order]
        hashes = mix(values ^ np.uint64(0x5851F42D4C957F2D))
        best: dict[int, tuple] = {}
        for length in np.unique(self.length[owner]).tolist():
            size = min(length, n_words)
            wide = max(size - SHINGLE + 1, 1)  # shingles of a window
            mine = self.length[owner] == length
            spot, of = position[mine], owner[mine]
            need = least_common(wide, max(length - SHINGLE + 1, 1))
            steps = crowded(spot, of, need, wide, len(values) - wide)
            prints = fingerprints(values, steps, wide, hashes)
            items, tables = self.index[length]
            place = of * (len(values) + 1) + spot  # ascends, as items do and spots of each
            many = max(1, (1 << 22) // len(items))
            for lo in range(0, len(steps), many):
                query, found = tables.within_radius(prints[lo : lo + many])
                step, item = steps[lo:][query], items[found]
                begin = item * (len(values) + 1) + step
                enough = np.searchsorted(place, begin + wide) - np.searchsorted(place, begin) >= need
                for s, i in zip(step[enough].tolist(), item[enough].tolist(), strict=True):
                    if i in best and best[i][1] == 1.0:
                        continue
                    got = weighted_similarity(values[s : s + wide], self.bag[i])
                    if got >= SIMILARITY and (i not in best or got > best[i][1]):
                        best[i] = (self.keys[i], got, s, size)
        return [best[i] for i in sorted(best)]


def _blocks(benchmark: DataFrame, text: str, key: str) -> Iterator[ItemIndex]:
    """Items in blocks of bounded size; the driver holds one block at a time."""
    keys, texts, size = [], [], 0
    for row in benchmark.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null").toLocalIterator():
        if texts and size + len(row.t) > ITEM_BLOCK_BYTES:
            yield ItemIndex(keys, texts)
            keys, texts, size = [], [], 0
        keys.append(row.k)
        texts.append(row.t)
        size += len(row.t)
    yield ItemIndex(keys, texts)


def mark(df: DataFrame, benchmark: DataFrame, text: str = "text", column: str = "contamination", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """Adds to all columns of `df` an array of (item_id, similarity, start_word, n_words), empty if clean."""
    key_type = benchmark.schema[item_key].dataType
    kind = pa.list_(pa.struct([("item_id", to_arrow_type(key_type)), ("similarity", pa.float64()), ("start_word", pa.int64()), ("n_words", pa.int64())]))
    names = ("item_id", "similarity", "start_word", "n_words")
    one = StructType([StructField(n, t) for n, t in zip(names, (key_type, DoubleType(), LongType(), LongType()), strict=True)])

    def one_pass(df: DataFrame, index: ItemIndex) -> DataFrame:
        sent = df.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for whole in batches:
                for batch in chunks(whole, text):
                    data, offsets = text_buffers(batch.column(text))
                    _, _, hashes, before = words(data, offsets)
                    values, starts = shingles(hashes, before, SHINGLE)
                    found = index.shared(values)
                    where = np.searchsorted(found, starts)
                    out = batch.column(column).to_pylist() if column in batch.schema.names else [[] for _ in range(batch.num_rows)]
                    for row in np.flatnonzero(np.diff(where)).tolist():
                        got = index.matches(values[starts[row] : starts[row + 1]], found[where[row] : where[row + 1]] - starts[row], int(before[row + 1] - before[row]))
                        out[row] = out[row] + [dict(zip(names, g, strict=True)) for g in got]
                    kept = [n for n in batch.schema.names if n != column]
                    yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(out, kind)], names=[*kept, column])

        kept = [f for f in df.schema.fields if f.name != column]
        schema = StructType([*kept, StructField(column, ArrayType(one))])
        return df.mapInArrow(run, schema)

    if column in df.columns:
        df = df.drop(column)
    for k, index in enumerate(_blocks(benchmark, item_text, item_key)):
        df = one_pass(stored(df, "marked") if k else df, index)
    return df


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each contaminated document and item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked = mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.select("doc_id", F.inline("contamination"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that no benchmark item contaminates stay."""
    marked = mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), column="__contamination")
    return marked.where(F.size("__contamination") == 0).drop("__contamination")


OP10_SQL = r"""
WITH t AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark
), w AS (
  SELECT side, id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM t
), s AS (
  SELECT side, id, len(w) AS words, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) END AS g FROM w WHERE len(w) > 0
), d AS (
  SELECT id AS doc_id, words, pos - 1 AS pos, g[pos] AS k FROM (SELECT *, unnest(generate_series(1, len(g))) AS pos FROM s WHERE side = 'd')
), i AS (
  SELECT item_id, words, n, k, count(*) AS c FROM (SELECT id AS item_id, words, len(g) AS n, unnest(g) AS k FROM s WHERE side = 'i') GROUP BY ALL
), hit AS (
  SELECT d.doc_id, d.pos, d.k, i.item_id, i.c, i.n, least(i.words, d.words) AS size, greatest(least(i.words, d.words) - 4, 1) AS wide, greatest(d.words - 4, 1) AS all_n FROM d JOIN i USING (k)
), placed AS (
  SELECT *, unnest(generate_series(greatest(pos - wide + 1, 0), least(pos, all_n - wide))) AS start FROM hit
), per AS (
  SELECT doc_id, item_id, start, n, size, wide, k, least(count(*), any_value(c)) AS c FROM placed GROUP BY doc_id, item_id, start, n, size, wide, k
), rated AS (
  SELECT doc_id, item_id, start, size, sum(c)::BIGINT / (wide + n - sum(c)::BIGINT) AS similarity FROM per GROUP BY doc_id, item_id, start, n, size, wide
)
SELECT doc_id, item_id, max(similarity) AS similarity, arg_max(start, (similarity, -start)) AS start_word, any_value(size) AS n_words FROM rated WHERE similarity >= 0.8 GROUP BY doc_id, item_id
"""
