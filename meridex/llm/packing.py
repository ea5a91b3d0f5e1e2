"""Packing documents into token sequences (operator 9).

Best-fit decreasing: a document longer than a window is first cut into full windows; what remains of each document
is placed, longest first, into the open window with the least room that still holds it. A segment tree over the
remaining capacities finds that window. Every Spark partition packs its own documents, `GROUP_TOKENS` or a
few more at a time, so memory is bounded, no stage needs all of them at once and a lost executor's work is simply done
again; the price is one loose end for each group.

Token ids come from a tokenizer file whose path is a parameter. Its pre-tokenizer must drop white space and never join
across it, and it must not tell capital letters from small ones (a file that does is refused), so a batch tokenises each
distinct word once.

Defined results: a null or empty text has the end token alone; repeated rows are packed once each; an empty table
gives no rows; a sequence of exactly a power of two tokens isn't padded, others are padded to the window.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textops import chunks, text_buffers, words

WINDOW = 4096
END = 2
#: Words whose ids a task keeps; when there are more it starts afresh. Affects speed only.
CACHED_WORDS = 1_000_000
#: Tokens that are packed together, up to the end of the document that reaches them.
GROUP_TOKENS = 1 << 23


class CapacityTree:
    """Counts of open windows by remaining capacity; finds the least capacity of at least n that is open."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, by: int) -> None:
        at = capacity + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def tightest(self, n: int) -> int | None:
        at = n + self.size
        if self.count[at]:
            return n
        while at > 1:  # up until a right sibling has an open window, then down to its leftmost one
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at + (not self.count[2 * at])
                return at - self.size
            at >>= 1
        return None


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int], int]:
    """Window and offset of each item (1 to `window` long), and the number of windows. Ties go by position."""
    place, offset = [0] * len(lengths), [0] * len(lengths)
    tree, open_by, number = CapacityTree(window), {}, 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        room = tree.tightest(n) if n < window else None
        if room is None:
            room, at, number = window, number, number + 1
        else:
            at = open_by[room].pop()
            tree.add(room, -1)
        place[i], offset[i] = at, window - room
        if room > n:
            open_by.setdefault(room - n, []).append(at)
            tree.add(room - n, 1)
    return place, offset, number


_tokenizers: dict[str, object] = {}


def tokenizer(path: str):
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


class WordIds:
    """Token ids of whole batches, through those of their distinct words.

    Words are found and told apart by numpy. A new word of the common form, letters and then ASCII marks, is
    tokenised as these two pieces, many joined by blanks in one call; each piece is one unit of the
    pre-tokenizer, so it ends with the first id whose token carries the word end. Any other word goes alone.
    """

    _FORM = re.compile(r"([A-Za-z\u00df-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)\Z")

    def __init__(self, path: str):
        self.model = tokenizer(path)
        vocabulary = self.model.get_vocab()
        whole, apart = self._alone(["Some  words\n\tHERE,now ? "]), self._alone(["some", "words", "here,now", "?"])
        if whole[0] != b"".join(apart):
            raise ValueError(f"{path}: words can't be tokenised one by one")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.hash, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.start = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.pieces: dict[str, bytes] = {"": b""}

    def _alone(self, some: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.model.encode_batch_fast(some, add_special_tokens=False)]

    def _learn_pieces(self, new: list[str]) -> None:
        for lo in range(0, len(new), 20_000):
            groups = [new[i : i + 50] for i in range(lo, min(lo + 20_000, len(new)), 50)]
            for group, e in zip(groups, self.model.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, np.uint32)
                cut = np.flatnonzero(self.ends[ids]) + 1
                if len(cut) == len(group) and cut[-1] == len(ids):
                    raw, at = ids.tobytes(), [0, *(4 * cut).tolist()]
                    self.pieces.update(zip(group, (raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)), strict=True))
                else:
                    self.pieces.update(zip(group, self._alone(group), strict=True))

    def _learn(self, new: list[str]) -> list[bytes]:
        split = [self._FORM.match(w) for w in new]
        split = [(m[1].lower(), m[2]) if m else None for m in split]
        self._learn_pieces(list({p for s in split if s for p in s}.difference(self.pieces)))
        odd = iter(self._alone([w for w, s in zip(new, split, strict=True) if not s]))
        return [self.pieces[s[0]] + self.pieces[s[1]] if s else next(odd) for s in split]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and for each text the number of ids before it."""
        start, end, hashes, before = words(data, offsets, lower=False)
        each, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hash) > CACHED_WORDS:
            self.clear()
        at = np.searchsorted(self.hash, each)
        known = np.zeros(len(each), bool)
        inside = at < len(self.hash)
        known[inside] = self.hash[at[inside]] == each[inside]
        if not known.all():
            raw = data.tobytes()
            new = [raw[a:b].decode() for a, b in zip(start[first[~known]].tolist(), end[first[~known]].tolist(), strict=True)]
            learnt = self._learn(new)
            rows = len(self.start) - 1 + np.arange(len(new))
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum([len(x) // 4 for x in learnt])])
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(learnt), np.uint32)])
            self.hash, self.row = np.insert(self.hash, at[~known], each[~known]), np.insert(self.row, at[~known], rows)
        row = self.row[np.searchsorted(self.hash, each)][which]
        length = np.diff(self.start)[row]
        total = np.zeros(len(row) + 1, np.int64)
        np.cumsum(length, out=total[1:])
        return self.ids[np.repeat(self.start[row] - total[:-1], length) + np.arange(total[-1])], total[before]


def pack(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", window: int = WINDOW, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row for each piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length[, ids].

    `window` must be a power of two. Sequence ids hold the partition's number in their upper bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        encoder = WordIds(path)
        keys, start, length, crc, total, ids, tokens_held = [], [], [], [], [], [], 0

        def placed() -> Iterator[pa.RecordBatch]:
            """The pieces at hand with their places; they are let go of."""
            nonlocal base, tokens_held
            place, offset, number = best_fit_decreasing(length, window)
            used = np.bincount(np.array(place, np.int64), np.array(length, np.float64), number).astype(np.int64)
            padded = [int(u) if u & (u - 1) == 0 else window for u in used.tolist()]
            for a in range(0, len(keys), 20_000):
                s = slice(a, a + 20_000)
                columns = [pa.array(keys[s], kind), *(pa.array(v, pa.int64()) for v in (start[s], length[s], crc[s], total[s], [base + p for p in place[s]], offset[s], [padded[p] for p in place[s]]))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids[s], pa.list_(pa.int64()))] * with_ids, names=names)
            for x in (keys, start, length, crc, total, ids):
                x.clear()
            base, tokens_held = base + number, 0

        for whole in batches:
            for batch in chunks(whole):
                tokens, at = encoder.encode(*text_buffers(batch.column("text")))
                for name, a, b in zip(batch.column("key").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    raw = tokens[a:b].tobytes() + end.to_bytes(4, "little")
                    n = len(raw) // 4
                    tokens_held += n
                    for a in range(0, n, window):
                        piece = raw[4 * a : 4 * (a + window)]
                        keys.append(name)
                        start.append(a)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(n)
                        if with_ids:
                            ids.append(np.frombuffer(piece, "<u4").astype(np.int64))
                    if tokens_held > GROUP_TOKENS:
                        yield from placed()
        yield from placed()

    names = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length"] + ["ids"] * with_ids
    named = df.schema[key].dataType.simpleString()
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[named]
    schema = f"key {named}, " + ", ".join(f"{c} long" for c in names[1:8]) + ", ids array<long>" * with_ids
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences; null and empty texts are their end token alone."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
