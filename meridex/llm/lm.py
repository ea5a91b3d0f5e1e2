"""Language-model scores from an Elias-Fano n-gram trie (operator 7).

Bigram model with absolute discounting: p(w | v) = (c(vw) - D) / c(v) + D k(v) / c(v) * p(w), with k(v) the number of
different successors of v, the first term 0 for pairs that never occur, and p(w | v) = p(w) = (c(w) + 1) / (N + V + 1)
where v was never seen. Counts come from all training documents; nothing is pruned, capped or sampled.

The trie is cut in shards by the hash of the context word. Each shard is one compact, memory-mapped file: a level of
words, monotone pointers from each to its successors, a level of successors relative to their context (all three
Elias-Fano coded) and one byte for each successor, its discounted share of the context's count quantised on a log scale.
A look-up finds the word, takes its range from two pointers, and searches the successor by its value relative to the
context: entries of equal upper bits are found by the bits' counts, the lower bits decide. Levels stay as they are coded.

Documents lie in blocks by hash. A block asks each shard once for its distinct words and word
pairs, sorted, and gets the counts and codes in the same order. So what is shuffled grows with the distinct pairs of
blocks, and a very common word or pair is one entry for each block. Contexts in buckets that hold more than a small
part of all words are spread by their successors over as many shards as they hold such parts, and a block asks all of
these for the number of successors, so scores don't depend on how documents are dealt; the 2**16 bucket counts are a
fixed size. Blocks and shards grow with the square root of the input up to `BLOCK_MOST` bytes and `SHARD_MOST` words, so
the rows that pass between them grow with the input up to there; beyond, rows get shorter, down to one pair each.

A shard's file lies in the task's own temporary folder and ends with the task; it is built again if the task is lost.

Defined results: a null or empty text has the end token alone; a null key counts as training; rows that repeat a key
are documents of their own; without training text every known count is 0 and p(w) = 1 / (V + 1) with V = 0.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packed import Distinct, EliasFano, distinct, pack_sorted, pack_values, unpack_sorted, unpack_values
from .textops import chunks, mix, text_buffers, words

DISCOUNT = 0.75
#: Bytes of text of a block, and words of text whose pairs one shard of the trie holds, about: up to 1 GB of text, and at most.
BLOCK_BYTES, BLOCK_MOST = 4 << 20, 16 << 20
SHARD_WORDS, SHARD_MOST = 1_000_000, 4_000_000
BUCKETS = 1 << 16
_END = np.uint64(0x3C6EF372FE94F82B)
_BEGIN = np.uint64(0xA54FF53A5F1D36F1)
_STEP = 85.0  # code k stands for the share 10 ** -(k / _STEP) ** 2, so shares near 1 are finest
_ABSENT = 255
_ASK = 1 << 18  # pairs of one look-up


class Trie:
    """One shard: words, pointers, successors and codes; written once and read through a memory map."""

    def __init__(self, data: np.ndarray):
        self.words, at = EliasFano.read(data, 0)
        self.pointers, at = EliasFano.read(data, at)
        self.names, at = EliasFano.read(data, at)
        self.successors, at = EliasFano.read(data, at)
        self.codes = data[at:]

    @staticmethod
    def write(path: str, context: np.ndarray, successor: np.ndarray, count: np.ndarray, discount: float = DISCOUNT) -> None:
        """Pairs must be distinct and sorted by context, then successor."""
        heads, first = np.unique(context, return_index=True)
        ends = np.append(first, len(context))
        total = np.add.reduceat(count, first) if len(first) else np.zeros(0, np.int64)
        share = (count - discount) / np.repeat(total, np.diff(ends))
        codes = np.minimum(np.rint(np.sqrt(np.maximum(-np.log10(share), 0)) * _STEP), _ABSENT - 1).astype(np.uint8)
        names, relative = np.unique(successor, return_inverse=True)
        row = np.repeat(np.arange(len(heads), dtype=np.uint64), np.diff(ends))
        sequence = row * np.uint64(max(len(names), 1)) + relative.astype(np.uint64)
        with open(path, "wb") as out:
            for level in (heads, ends.astype(np.uint64), names, sequence):
                for part in EliasFano.of(level).parts():
                    out.write(part.tobytes())
            out.write(codes.tobytes())

    def find(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Codes of the pairs, `_ABSENT` for those that aren't there; fastest where pairs of a context stand together."""
        out = np.full(len(context), _ABSENT, np.uint8)
        new = np.ones(len(context), bool)
        new[1:] = context[1:] != context[:-1]
        run = np.cumsum(new) - 1
        row, seen = self.words.successor(context[new])  # once for each run of a context
        ask = np.flatnonzero(seen[run])
        row, run = row[seen], (np.cumsum(seen) - 1)[run[ask]]
        begin, end = self.pointers.at(row).astype(np.int64), self.pointers.at(row + 1).astype(np.int64)
        name, known = self.names.successor(successor[ask])
        ask, run, name = ask[known], run[known], name[known]
        at, found = self.successors.successor(row[run].astype(np.uint64) * np.uint64(max(self.names.number, 1)) + name.astype(np.uint64))
        found &= (at >= begin[run]) & (at < end[run])
        out[ask[found]] = self.codes[at[found]]
        return out


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's words and then its end, and where each text begins."""
    _, _, hashes, before = words(data, offsets)
    starts = before + np.arange(len(before))
    out = np.full(int(starts[-1]), _END, np.uint64)
    ends = np.zeros(len(out), bool)
    ends[starts[1:] - 1] = True
    out[~ends] = hashes
    return out, starts


class Request:
    """What a block asks: its distinct words, and its distinct pairs by shard, in a fixed order."""

    def __init__(self, tokens: np.ndarray, starts: np.ndarray, train: np.ndarray, shards: int, spread: np.ndarray, word_bits: int, next_bits: int):
        """`spread`: over how many shards the contexts of each bucket lie, and the beginning of texts after the last."""
        shift = np.uint64(64 - word_bits)
        weight = np.repeat(train, np.diff(starts)).astype(np.int64)
        self.word, self.which = np.unique(tokens >> shift, return_inverse=True)
        self.count = np.bincount(self.which, weight, len(self.word)).astype(np.uint64)
        self.hash = np.append(self.word, _BEGIN >> shift)
        place = np.concatenate([[0], self.which[:-1]]) if len(tokens) else self.which
        place[starts[:-1]] = len(self.word)
        # a pair is named by its context's place and its successor's hash
        successor = mix(tokens) >> np.uint64(64 - next_bits)
        key = (place.astype(np.uint64) << np.uint64(next_bits)) | successor
        pair, self.pair_of = np.unique(key, return_inverse=True)
        self.pair_count = np.bincount(self.pair_of, weight, len(pair)).astype(np.uint64)
        self.context = (pair >> np.uint64(next_bits)).astype(np.int64)  # a place in `hash`
        self.successor = pair & ((np.uint64(1) << np.uint64(next_bits)) - np.uint64(1))
        own = (mix(self.hash) >> np.uint64(33)).astype(np.int64)
        self.word_shard = own[:-1] % shards
        over = np.append(spread[(mix(self.word) & np.uint64(BUCKETS - 1)).astype(np.int64)], spread[-1])
        piece = (mix(self.hash[self.context] ^ self.successor) >> np.uint64(33)).astype(np.int64) % over[self.context]
        self.pair_shard = (own[self.context] + piece) % shards
        # spread contexts, once for each of their shards
        wide = np.flatnonzero(over > 1)
        self.wide = np.repeat(wide, over[wide])
        step = np.arange(len(self.wide)) - np.repeat(np.cumsum(over[wide]) - over[wide], over[wide])
        self.wide_shard = (own[self.wide] + step) % shards

    def parts(self, shards: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(shard, its words, contexts, how many of them are the shard's words, pairs of each, pairs), as positions.

        Contexts that the shard owns come first, then spread ones by hash; those without a pair are asked for all the same.
        """
        narrow = np.min_scalar_type(shards)  # up to two bytes are sorted by their digits
        orders = [np.argsort(x.astype(narrow), kind="stable") for x in (self.word_shard, self.pair_shard, self.wide_shard)]
        edges = [np.searchsorted(x[o], np.arange(shards + 1)) for x, o in zip((self.word_shard, self.pair_shard, self.wide_shard), orders, strict=True)]
        for s in range(shards):
            w, p, x = (o[e[s] : e[s + 1]] for o, e in zip(orders, edges, strict=True))
            if not len(w) + len(p) + len(x):
                continue
            heads = distinct(np.concatenate([self.context[p], self.wide[x]]))
            owned = np.isin(heads, w)
            far = heads[~owned]
            heads = np.concatenate([heads[owned], far[np.argsort(self.hash[far], kind="stable")]])
            first = np.searchsorted(self.context[p], heads)
            size = np.searchsorted(self.context[p], heads, "right") - first
            entry = p[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(len(p))]
            yield s, w, heads, int(owned.sum()), size, entry


def score(df: DataFrame, train, text: str = "text", key: str = "doc_id", discount: float = DISCOUNT) -> DataFrame:
    """(key, train, n_tokens, n_known, train_tokens, base_score, score) for each row; keys must be integers.

    `train` is a boolean column: the rows that the model learns from.
    """
    spark = df.sparkSession
    docs = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    word_bits = min(60, 2 * max(total, 1).bit_length())
    next_bits = min(62 - 22, max(total, 1).bit_length() + 10)
    grown = max(1.0, (total / (1 << 30)) ** 0.5)
    shards = max(spark.sparkContext.defaultParallelism, int(total / 6 / min(SHARD_WORDS * grown, SHARD_MOST)) + 1)
    number_of_blocks = int(total / min(BLOCK_BYTES * grown, BLOCK_MOST)) + 1

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a task: how many training tokens there are, in which buckets tokens are, and the distinct training words."""
        buckets, number, found = np.zeros(BUCKETS, np.int64), 0, Distinct()
        for whole in batches:
            for batch in chunks(whole):
                tokens, starts = tokens_of(*text_buffers(batch.column("text")))
                flag = np.repeat(batch.column("train").to_numpy(zero_copy_only=False).astype(bool), np.diff(starts))
                word = tokens >> np.uint64(64 - word_bits)
                buckets += np.bincount((mix(word) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
                number += int(flag.sum())
                found.add(word[flag])
        held = found.all()
        shard = (mix(held) >> np.uint64(33)).astype(np.int64) % shards
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(shards + 1))
        rows = [(s, pack_sorted(held[order[a:b]])) for s, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
        rows.append((-1, pack_values(np.append(buckets, number).astype(np.uint64))))
        s, p = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(p, pa.binary())], names=["shard", "packed"])

    def gather(table: pa.Table) -> pa.Table:
        parts = table.column("packed").to_pylist()
        if table.column("shard")[0].as_py() < 0:
            return pa.table({"number": pa.array([0], pa.int64()), "packed": pa.array([pack_values(sum(unpack_values(p) for p in parts))], pa.binary())})
        held = distinct(np.concatenate([unpack_sorted(p) for p in parts]))
        return pa.table({"number": pa.array([len(held)], pa.int64()), "packed": pa.array([None], pa.binary())})

    found = docs.select("text", "train").mapInArrow(survey, "shard long, packed binary").groupBy("shard").applyInArrow(gather, "number long, packed binary")
    surveyed = found.agg(F.sum("number").alias("v"), F.max("packed").alias("packed")).first()  # one row of a fixed size
    sums = unpack_values(surveyed.packed or b"").astype(np.int64) if surveyed.packed else np.zeros(BUCKETS + 1, np.int64)
    vocabulary, number = surveyed.v or 0, int(sums[-1])
    counted = docs.agg(F.count("*").alias("n"), F.count_if("train").alias("train")).first()
    n_train = counted.train
    held = np.append(sums[:-1], counted.n)  # begins of texts are a context too
    spread = spark.sparkContext.broadcast(np.clip(-(-held * 8 * shards // max(int(sums[:-1].sum()), 1)), 1, shards))
    floor = float(number + vocabulary + 1)
    wide = -(-next_bits // 8)

    def block_request(table: pa.Table) -> tuple[pa.Table, Request, np.ndarray]:
        order = pc.sort_indices(table, sort_keys=[("key", "ascending"), ("text", "ascending"), ("train", "ascending")], null_placement="at_start")
        table = table.take(order)
        tokens, starts = tokens_of(*text_buffers(table.column("text")))
        flags = table.column("train").to_numpy().astype(bool)
        return table, Request(tokens, starts, flags, shards, spread.value, word_bits, next_bits), starts

    def ask(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        _, r, _ = block_request(table)
        rows = []
        for s, w, heads, near, size, entry in r.parts(shards):
            raw = r.successor[entry].view(np.uint8).reshape(-1, 8)[:, :wide] if len(entry) else np.zeros((0, wide), np.uint8)
            places = np.searchsorted(w, heads[:near]).astype(np.uint64)
            rows.append((s, block, pack_sorted(r.word[w]), pack_values(r.count[w]), pack_sorted(places), pack_sorted(r.hash[heads[near:]]), pack_values(size.astype(np.uint64)), raw.tobytes(), pack_values(r.pair_count[entry])))
        columns = zip(*rows, strict=True)
        return pa.table({f.name: pa.array(c, f.type) for f, c in zip(asked, columns, strict=True)})

    def answer(table: pa.Table) -> pa.Table:
        word, count, context, successor, many, sizes = [], [], [], [], [], []
        for row in table.to_pylist():
            w, size = unpack_sorted(row["words"]), unpack_values(row["sizes"]).astype(np.int64)
            head = np.concatenate([w[unpack_sorted(row["near"]).astype(np.int64)], unpack_sorted(row["far"])])
            raw = np.zeros((len(row["next"]) // wide, 8), np.uint8)
            raw[:, :wide] = np.frombuffer(row["next"], np.uint8).reshape(-1, wide)
            word.append(w)
            count.append(unpack_values(row["counts"]).astype(np.int64))
            context.append(np.repeat(head, size))
            successor.append(raw.view(np.uint64).ravel())
            many.append(unpack_values(row["pairs"]).astype(np.int64))
            sizes.append((len(w), head, len(raw)))
        every, back = np.unique(np.concatenate(word), return_inverse=True)
        totals = np.bincount(back, np.concatenate(count), len(every)).astype(np.int64)
        cs, ss, ms = (np.concatenate(x) for x in (context, successor, many))
        order = np.lexsort((ss, cs))
        c, s = cs[order], ss[order]
        new = np.ones(len(c), bool)
        new[1:] = (c[1:] != c[:-1]) | (s[1:] != s[:-1])
        first = np.flatnonzero(new)
        c, s, m = c[first], s[first], np.add.reduceat(ms[order], first) if len(first) else ms[:0]  # each pair once
        seen = m > 0
        heads, at = np.unique(c[seen], return_index=True)
        sums = np.add.reduceat(m[seen], at) if len(at) else m[:0]
        kinds = np.diff(np.append(at, seen.sum()))
        with tempfile.TemporaryDirectory() as folder:
            path = os.path.join(folder, "trie")
            Trie.write(path, c[seen], s[seen], m[seen], discount)
            trie = Trie(np.memmap(path, np.uint8, "r"))
            found = np.concatenate([np.zeros(0, np.uint8), *(trie.find(c[lo : lo + _ASK], s[lo : lo + _ASK]) for lo in range(0, len(c), _ASK))])
            del trie
        codes = np.empty(len(cs), np.uint8)
        codes[order] = found[np.cumsum(new) - 1]
        out, w0, p0 = [], 0, 0
        for n_words, head, n_pairs in sizes:
            row = np.minimum(np.searchsorted(heads, head), max(len(heads) - 1, 0))
            own = heads[row] == head if len(heads) else np.zeros(len(head), bool)
            of = lambda x: pack_values(np.where(own, x[row], 0).astype(np.uint64) if len(heads) else np.zeros(len(head), np.uint64))  # noqa: B023, E731
            out.append((pack_values(totals[back[w0 : w0 + n_words]].astype(np.uint64)), of(sums), of(kinds), codes[p0 : p0 + n_pairs].tobytes()))
            w0, p0 = w0 + n_words, p0 + n_pairs
        columns = list(zip(*out, strict=True))
        return pa.table({"block": table.column("block"), "shard": table.column("shard"), **{n: pa.array(x, pa.binary()) for n, x in zip(("counts", "parts", "kinds", "codes"), columns, strict=True)}})

    def rate(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in result})
        table, r, starts = block_request(left)
        got = {row["shard"]: row for row in right.to_pylist()}
        known, kinds, seen = np.zeros(len(r.word) + 1, np.int64), np.zeros(len(r.word) + 1, np.int64), np.zeros(len(r.context))
        known[-1] = n_train
        for s, w, heads, _, size, entry in r.parts(shards):
            known[w] = unpack_values(got[s]["counts"]).astype(np.int64)
            part, code = unpack_values(got[s]["parts"]), np.frombuffer(got[s]["codes"], np.uint8)
            kinds[heads] += unpack_values(got[s]["kinds"]).astype(np.int64)
            seen[entry] = np.where(code == _ABSENT, 0, np.repeat(part, size) * 10.0 ** -((code / _STEP) ** 2))
        lower = (known[r.which] + 1) / floor
        above = known[r.context[r.pair_of]]
        p = np.where(above > 0, (seen[r.pair_of] + discount * kinds[r.context[r.pair_of]] * lower) / np.maximum(above, 1), lower)
        text = np.repeat(np.arange(table.num_rows), np.diff(starts))
        sums = lambda x: np.bincount(text, x, table.num_rows)
        n = np.diff(starts)
        columns = [table.column("key"), table.column("train"), n, sums(known[r.which] > 0).astype(np.int64), np.full(len(n), number), sums(np.log10(lower)), sums(np.log10(p))]
        return pa.table({f.name: x if isinstance(x, pa.ChunkedArray) else pa.array(x, f.type) for f, x in zip(result, columns, strict=True)})

    binary = ("words", "counts", "near", "far", "sizes", "next", "pairs")
    asked = [pa.field("shard", pa.int64()), pa.field("block", pa.int64()), *(pa.field(c, pa.binary()) for c in binary)]
    result = [pa.field("key", pa.int64()), pa.field("train", pa.bool_()), *(pa.field(c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")), pa.field("base_score", pa.float64()), pa.field("score", pa.float64())]
    blocks = docs.withColumn("block", F.pmod(F.xxhash64("key", "text"), F.lit(number_of_blocks))).select("block", "key", "text", "train")
    requests = blocks.groupBy("block").applyInArrow(ask, "shard long, block long, " + ", ".join(f"{c} binary" for c in binary))
    answers = requests.groupBy("shard").applyInArrow(answer, "block long, shard long, counts binary, parts binary, kinds binary, codes binary")
    rated = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(rate, "key long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return rated.withColumnRenamed("key", key)


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score by a model of the documents whose crc32 of doc_id modulo 7 isn't 2."""
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    rated = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), ~held)
    return rated.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
