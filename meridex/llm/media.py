"""Media columns: baseline JPEG (operator 1).

`decode_scans` is a baseline decoder: marker parsing, Huffman tables, restart intervals. It decodes all restart
intervals of a batch of pictures in step, one symbol of each per round, so that numpy does the work. From the
decoded coefficients `thumbnail` reconstructs a DC-only luminance picture, one pixel for each block.

`store_payload` writes any bytes as a JPEG without loss: the bytes are the quantised coefficients of 8 x 8 blocks
in scan order (a byte b is the coefficient 256 + b, of 9 magnitude bits, so one Huffman code serves all of them),
one block to each restart interval, blocks in a nearly square grid. The number of payload bytes stands in a
comment segment.

Defined results: a null or empty text is one block of zero bytes; a picture that isn't baseline JPEG or lacks a table
gives null features (`media_features`), never an error; one that another writer made gives a null payload; repeated rows
give repeated, equal results.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import chunks, text_buffers

BLOCK = 64
#: Code lengths (one code of one bit) and the symbol: run 0, nine magnitude bits.
_ONE_CODE = bytes([1] + [0] * 15) + bytes([9])
_NOTE = b"payload "
#: What reading a picture that breaks the rules may raise.
BROKEN = (ValueError, LookupError, ArithmeticError, struct.error)


@dataclass
class Picture:
    """What the markers of a baseline JPEG say. `plan`: (component, DC table, AC table) of each block of an MCU."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[int, bytes] = field(default_factory=dict)
    restart: int = 0
    plan: list[tuple[int, int, int]] = field(default_factory=list)
    comment: bytes = b""
    scan: bytes = b""

    def grid(self) -> tuple[int, int]:
        """MCUs across and down."""
        if len(self.components) == 1:
            h = v = 1
        else:
            h, v = max(c[1] for c in self.components), max(c[2] for c in self.components)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


def parse(raw: bytes) -> Picture:
    """Reads the marker segments; raises ValueError for anything but a baseline, single-scan JPEG."""
    if raw[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    out, at = Picture(), 2
    while at + 4 <= len(raw):
        if raw[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = raw[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = struct.unpack(">H", raw[at + 2 : at + 4])[0]
        body = raw[at + 4 : at + 2 + size]
        if len(body) != size - 2:
            raise ValueError("a segment is cut off")
        at += 2 + size
        if marker == 0xC0:
            bits, out.height, out.width, n = struct.unpack(">BHHB", body[:6])
            if bits != 8 or not out.width or not out.height:
                raise ValueError("only 8 bits and known sizes")
            out.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not baseline")
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                out.tables[body[0]] = bytes(body[1:n])
                body = body[n:]
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 65 + 64 * wide
                out.quant[body[0] & 15] = np.frombuffer(body[1:n], ">u2" if wide else "u1").astype(np.int32)
                body = body[n:]
        elif marker == 0xDD:
            out.restart = struct.unpack(">H", body)[0]
        elif marker == 0xFE:
            out.comment = bytes(body)
        elif marker == 0xDA:
            if body[0] != len(out.components):
                raise ValueError("several scans")
            uses = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            for k, (name, h, v, _) in enumerate(out.components):
                dc, ac = uses[name] >> 4, 0x10 | uses[name] & 15
                if dc not in out.tables or ac not in out.tables:
                    raise ValueError("a Huffman table is missing")
                out.plan += [(k, dc, ac)] * (1 if len(out.components) == 1 else h * v)
            end = raw.rfind(b"\xff\xd9")
            out.scan = raw[at : end if end >= at else len(raw)]
            return out
    raise ValueError("no scan")


def lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 16 coming bits: the length of the code they begin with (0: none) and its symbol."""
    length, symbol = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    code, k = 0, 16
    for bits in range(1, 17):
        for _ in range(table[bits - 1]):
            lo = code << (16 - bits)
            length[lo : lo + (1 << (16 - bits))] = bits
            symbol[lo : lo + (1 << (16 - bits))] = table[k]
            code, k = code + 1, k + 1
        code <<= 1
    return length, symbol


def _intervals(scan: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The scan without stuffing and restart markers, and where its restart intervals begin in that."""
    ff = np.flatnonzero(scan[:-1] == 0xFF)
    after = scan[ff + 1]
    drop = np.zeros(len(scan), bool)
    drop[ff[after == 0] + 1] = True
    marks = ff[(after >= 0xD0) & (after <= 0xD7)]
    drop[marks] = drop[marks + 1] = True
    kept = np.cumsum(~drop)
    return scan[~drop], np.concatenate([[0], kept[marks]])


def decode_scans(pictures: list[Picture]) -> list[np.ndarray]:
    """Quantised coefficients (blocks x 64, scan order, DC undone) of pictures, blocks in scan order."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pictures)
    alike: dict[tuple, list[int]] = {}
    for i, p in enumerate(pictures):
        alike.setdefault((tuple(p.plan), tuple(sorted(p.tables.items()))), []).append(i)
    for (plan, tables), members in alike.items():
        codes = {k: lookup(v) for k, v in tables}
        parts, lane_at, lane_blocks, first_block, owner, at, blocks = [], [], [], [], [], 0, 0
        for i in members:
            p = pictures[i]
            data, starts = _intervals(np.frombuffer(p.scan, np.uint8))
            across, down = p.grid()
            mcus = across * down
            if mcus * len(plan) > 4 * len(p.scan):  # a block takes two bits at least
                raise ValueError("the scan is too short for its blocks")
            each = p.restart or mcus
            number = -(-mcus // each)
            if len(starts) < number:
                raise ValueError("restart intervals are missing")
            size = np.full(number, each * len(plan), np.int64)
            size[-1] = (mcus - each * (number - 1)) * len(plan)
            parts.append(data)
            lane_at.append(at + starts[:number])
            lane_blocks.append(size)
            first_block.append(blocks + np.concatenate([[0], np.cumsum(size)[:-1]]))
            owner.append((blocks, blocks + mcus * len(plan)))
            at += len(data)
            blocks += mcus * len(plan)
        raw = np.concatenate([*parts, np.full(8, 0xFF, np.uint8)]).astype(np.uint64)
        window = np.zeros(len(raw) - 7, np.uint64)  # the 40 bits from each byte on
        for k in range(5):
            window = (window << np.uint64(8)) | raw[k : k + len(window)]
        coefficients = np.zeros((blocks, 64), np.int16)
        position = np.concatenate(lane_at).astype(np.int64) * 8
        number, first = np.concatenate(lane_blocks), np.concatenate(first_block)
        order = np.argsort(-number, kind="stable")
        position, number, first = position[order], number[order], first[order]
        predictor = np.zeros((len(number), max(k for k, _, _ in plan) + 1), np.int32)
        limit = (len(window) - 1) * 8

        def symbol(where: np.ndarray, code: tuple[np.ndarray, np.ndarray], window=window, limit=limit) -> tuple[np.ndarray, ...]:
            """Reads a code and its magnitude bits at each bit position: (symbol, value, next position)."""
            if len(where) and where.max() > limit:
                raise ValueError("the scan is cut off")
            bits = window[where >> 3] << ((where & 7).astype(np.uint64) + np.uint64(24))
            head = (bits >> np.uint64(48)).astype(np.int64)
            length = code[0][head]
            if not length.all():
                raise ValueError("no such code")
            what = code[1][head]
            size = (what & 15).astype(np.int64)
            # up to 7 + 16 bits are used of 40: 17 are left for up to 15 magnitude bits
            extra = ((bits << length.astype(np.uint64)) >> np.uint64(48)).astype(np.int64) >> (16 - size)
            value = np.where((size > 0) & (extra < (1 << np.maximum(size - 1, 0))), extra - (1 << size) + 1, extra)
            return what, np.where(size > 0, value, 0), where + length + size

        for block in range(int(number[0]) if len(number) else 0):
            live = int(np.searchsorted(-number, -block, "left"))
            component, dc, ac = plan[block % len(plan)]
            _, value, position[:live] = symbol(position[:live], codes[dc])
            predictor[:live, component] += value.astype(np.int32)
            row = first[:live] + block
            coefficients[row, 0] = predictor[:live, component]
            lanes = np.arange(live)
            k = np.ones(live, np.int64)
            where = position[:live].copy()
            while len(lanes):
                what, value, where = symbol(where, codes[ac])
                run = (what >> 4).astype(np.int64)
                sized = (what & 15) > 0
                k = k + run
                if (k[sized] > 63).any():
                    raise ValueError("a run leaves its block")
                coefficients[row[sized], k[sized]] = value[sized]
                k = np.where(sized, k + 1, np.where(run == 15, k + 1, 64))
                going = k < 64
                if not going.all():
                    position[lanes[~going]] = where[~going]
                    lanes, k, where, row = lanes[going], k[going], where[going], row[going]
        for i, (a, b) in zip(members, owner, strict=True):
            out[i] = coefficients[a:b]
    return out


def thumbnail(p: Picture, coefficients: np.ndarray) -> np.ndarray:
    """One luminance pixel for each block of the first component, from DC alone."""
    across, down = p.grid()
    _, h, v, table = p.components[0]
    if len(p.components) == 1:
        h = v = 1
    luma = coefficients.reshape(across * down, len(p.plan), 64)[:, : h * v, 0].astype(np.int32)
    pixel = np.clip(np.rint(luma * int(p.quant[table][0]) / 8) + 128, 0, 255).astype(np.uint8)
    return pixel.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)


def average_hash(pixels: np.ndarray) -> int:
    """64 bits: which cells of an 8 x 8 grid over the picture are brighter than the mean of the cells."""
    rows = np.arange(9) * pixels.shape[0] // 8
    cols = np.arange(9) * pixels.shape[1] // 8
    sums = np.zeros((pixels.shape[0] + 1, pixels.shape[1] + 1))
    sums[1:, 1:] = pixels.cumsum(0, dtype=np.int64).cumsum(1)
    r0, c0 = np.minimum(rows[:-1], pixels.shape[0] - 1), np.minimum(cols[:-1], pixels.shape[1] - 1)
    r1, c1 = np.maximum(rows[1:], r0 + 1), np.maximum(cols[1:], c0 + 1)
    cells = sums[np.ix_(r1, c1)] - sums[np.ix_(r0, c1)] - sums[np.ix_(r1, c0)] + sums[np.ix_(r0, c0)]
    cells /= np.outer(r1 - r0, c1 - c0)
    return int("".join("1" if x else "0" for x in (cells > cells.mean()).ravel()), 2)


def write_pictures(payloads: list[bytes]) -> list[bytes]:
    """A JPEG for each payload, whose length must be a positive multiple of 64."""
    grids = [(w := int(np.ceil(np.sqrt(n := len(p) // BLOCK))), -(-n // w), n) for p in payloads]
    number = np.array([w * h for w, h, _ in grids])
    begin = np.concatenate([[0], np.cumsum(number)])
    blocks = np.zeros((int(begin[-1]), BLOCK), np.uint64)
    for p, (_, _, n), b in zip(payloads, grids, begin, strict=False):
        blocks[b : b + n] = np.frombuffer(p, np.uint8).reshape(n, BLOCK)
    code = (blocks + np.uint64(256)).reshape(-1, 16, 4)
    forty = (code[:, :, 0] << np.uint64(30)) | (code[:, :, 1] << np.uint64(20)) | (code[:, :, 2] << np.uint64(10)) | code[:, :, 3]
    coded = np.zeros((len(blocks), 82), np.uint8)
    for k in range(5):
        coded[:, k:80:5] = (forty >> np.uint64(32 - 8 * k)).astype(np.uint8)
    stuffed = coded == 0xFF
    coded[:, 80] = 0xFF
    coded[:, 81] = 0xD0 + (np.arange(len(blocks)) - np.repeat(begin[:-1], number)) % 8
    flat, grow = coded.ravel(), 1 + stuffed.ravel().astype(np.int64)
    ends = np.cumsum(grow)
    scan = np.repeat(flat, grow)
    scan[ends[stuffed.ravel()] - 1] = 0
    out = []
    for p, (w, h, _), a, b in zip(payloads, grids, begin[:-1], begin[1:], strict=True):
        if w > 8191 or h > 8191:
            raise ValueError("a picture has at most 8191 x 8191 blocks")
        lo, hi = int(ends[a * 82 - 1]) if a else 0, int(ends[b * 82 - 1]) - 2  # no restart marker after the last
        note = _NOTE + str(len(p)).encode()
        segments = [
            (0xFE, note), (0xDB, bytes([0] + [1] * 64)), (0xC0, struct.pack(">BHHBBBB", 8, h * 8, w * 8, 1, 1, 0x11, 0)),
            (0xC4, b"\x00" + _ONE_CODE), (0xC4, b"\x10" + _ONE_CODE), (0xDD, struct.pack(">H", 1)), (0xDA, bytes([1, 1, 0, 0, 63, 0])),
        ]
        head = b"".join(struct.pack(">BBH", 0xFF, m, len(x) + 2) + x for m, x in segments)
        out.append(b"\xff\xd8" + head + scan[lo:hi].tobytes() + b"\xff\xd9")
    return out


def read_payload(p: Picture, coefficients: np.ndarray) -> bytes | None:
    """The bytes that `write_pictures` stored, or None if it didn't write this picture."""
    number = p.comment[len(_NOTE) :]
    if not p.comment.startswith(_NOTE) or not number.isdigit() or int(number) > coefficients.size:
        return None
    values = coefficients.ravel()[: int(number)] - 256
    return values.astype(np.uint8).tobytes() if ((values >= 0) & (values < 256)).all() else None


def store_payload(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, media): each text as UTF-8 with zero bytes up to a positive multiple of 64, as a JPEG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                data, offsets = text_buffers(batch.column("text"))
                raw = [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                media = write_pictures([x + bytes(-len(x) % BLOCK or (0 if x else BLOCK)) for x in raw])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), pa.array(np.diff(offsets), pa.int64()), pa.array(media, pa.binary())], names=["key", "n_bytes", "media"]
                )

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_bytes long, media binary")
    return out.withColumnRenamed("key", key)


def media_features(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """Decodes a column of JPEGs: sizes, DC-only thumbnail and its hashes, and the stored payload's checksums.

    Null, broken or non-baseline pictures give null in every column but those of `keep`.
    """
    fields = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width int, height int, thumb_width int, thumb_height int, thumb_hash string, thumb_sha256 string"
    names = [x.split()[0] for x in fields.split(", ")]

    def features(raw: bytes, p: Picture, coefficients: np.ndarray) -> tuple:
        small = thumbnail(p, coefficients)
        payload = read_payload(p, coefficients)
        known = (None, None, None) if payload is None else (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]))
        return (*known, len(raw), hashlib.sha256(raw).hexdigest(), p.width, p.height, small.shape[1], small.shape[0], f"{average_hash(small):016x}", hashlib.sha256(small.tobytes()).hexdigest())

    def decoded(raws: list[bytes | None]) -> list[tuple]:
        out: list[tuple] = [(None,) * len(names)] * len(raws)
        good: list[tuple[int, Picture]] = []
        for i, raw in enumerate(raws):
            try:
                good.append((i, parse(raw or b"")))
            except BROKEN:
                continue
        try:
            found = decode_scans([p for _, p in good])
        except BROKEN:
            if len(raws) > 1:  # one of them is broken: each alone
                return [x for raw in raws for x in decoded([raw])]
            return out
        for (i, p), coefficients in zip(good, found, strict=True):
            try:
                out[i] = features(raws[i], p, coefficients)
            except BROKEN:
                continue
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = 0
            column = whole.column("media")
            while at < whole.num_rows:
                raws, size = [], 0
                while at + len(raws) < whole.num_rows and size < 1 << 20:
                    raws.append(column[at + len(raws)].as_py())
                    size += len(raws[-1] or b"")
                part = whole.slice(at, len(raws))
                at += len(raws)
                columns = list(zip(*decoded(raws), strict=True))
                made = [pa.array(v, t) for v, t in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + made, names=[*keep, *names])

    kinds = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[x.split()[1]] for x in fields.split(", ")]
    head = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, F.col(media).alias("media")).mapInArrow(run, f"{head}, {fields}")


def op1_media(spark, sf_dir: str) -> DataFrame:
    """Every document stored as a JPEG, read back and described."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = media_features(store_payload(docs))
    feature = F.format_string("%dx%d:%s:%s", "width", "height", "thumb_hash", F.substring("thumb_sha256", 1, 16))
    return seen.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "width", "height")
