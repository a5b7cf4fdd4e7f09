"""TIFF files as rows: one row for each page, with its samples decoded.

The reader walks the chain of image directories in either byte order, reads strips or tiles, decodes
PackBits, LZW or deflate, and undoes horizontal differencing. The writer is there to store a payload
as pages. Files are independent of each other, so both run inside `mapInPandas` without a shuffle.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, small_batches, table

# Fixed values of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_SIZES, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES = 322, 323, 324, 325
NONE, LZW, DEFLATE, DEFLATE_OLD, PACKBITS = 1, 5, 8, 32946, 32773
KINDS = {1: "B", 3: "H", 4: "I"}
#: Most bytes that a byte of a file can decode to, in any of the compressions.
EXPANSION = 4_096
CLEAR, END, FIRST_FREE = 256, 257, 258

PAYLOAD_UNIT = 576
PAGE_ROWS, STRIP_ROWS, TILE = 64, 16, (64, 16)
#: How the writer stores pages in turn: 0 deflate strips, 1 LZW strips, 2 PackBits strips, 3 deflate tiles.
SCHEMES = (0, 2, 3, 0, 0, 2, 3, 0, 0, 2, 3, 0, 0, 1, 3, 0)


def packbits_decode(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        head = data[at]
        if head < 128:
            out.append(data[at + 1 : at + 2 + head])
            at += 2 + head
        elif head > 128:
            out.append(data[at + 1 : at + 2] * (257 - head))
            at += 2
        else:
            at += 1
    return b"".join(out)


def packbits_encode(row: bytes) -> bytes:
    """One row: runs of three and more as runs, the rest as literals."""
    samples = np.frombuffer(row, np.uint8)
    starts = np.r_[0, np.flatnonzero(np.diff(samples)) + 1, len(samples)]
    out, literal = bytearray(), 0

    def flush(end: int) -> None:
        for a in range(literal, end, 128):
            piece = row[a : min(a + 128, end)]
            out.append(len(piece) - 1)
            out.extend(piece)

    for k in np.flatnonzero(np.diff(starts) >= 3):
        a, b = int(starts[k]), int(starts[k + 1])
        flush(a)
        for x in range(a, b, 128):
            n = min(128, b - x)
            out.extend((257 - n, row[a]) if n > 1 else (0, row[a]))
        literal = b
    flush(len(row))
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    codes, widths = [CLEAR], [9]
    table: dict[int, int] = {}
    free, width, prefix = FIRST_FREE, 9, -1
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        key = prefix << 8 | byte
        known = table.get(key)
        if known is not None:
            prefix = known
            continue
        codes.append(prefix)
        widths.append(width)
        table[key] = free
        free += 1
        if free == 4094:
            codes.append(CLEAR)
            widths.append(12)
            table, free, width = {}, FIRST_FREE, 9
        elif free == 512 or free == 1024 or free == 2048:
            width += 1
        prefix = byte
    if prefix >= 0:
        codes.append(prefix)
        widths.append(width)
        free += 1
        if free in (512, 1024, 2048):
            width += 1
    codes.append(END)
    widths.append(width)
    code, size = np.array(codes, np.int64), np.array(widths, np.int64)
    ends = np.cumsum(size)
    bits = np.zeros(ends[-1], np.uint8)
    for j in range(12):
        wide = size > j
        bits[ends[wide] - 1 - j] = code[wide] >> j & 1
    return np.packbits(bits).tobytes()


def lzw_decode(data: bytes) -> bytes:
    padded = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    triples = (padded[:-2] << 16 | padded[1:-1] << 8 | padded[2:]).tolist()
    single = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, at, before, out = list(single), 9, 0, None, []
    last_bit = len(data) * 8
    while at + width <= last_bit:
        code = triples[at >> 3] >> 24 - width - (at & 7) & (1 << width) - 1
        at += width
        if code == END:
            break
        if code == CLEAR:
            table, width, before = list(single), 9, None
            continue
        if before is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else before + before[:1]
            table.append(before + entry[:1])
            if len(table) in (511, 1023, 2047):
                width += 1
        out.append(entry)
        before = entry
    return b"".join(out)


def _decoded(data: bytes, compression: int, most: int) -> bytes:
    """A strip or tile decoded; of deflate no more than `most` bytes, as many as the page needs of it."""
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return packbits_decode(data)
    if compression == LZW:
        return lzw_decode(data)
    if compression in (DEFLATE, DEFLATE_OLD):
        return zlib.decompressobj().decompress(data, most)
    raise ValueError(f"compression {compression} is not supported")


def _directories(data: bytes) -> Iterator[dict[int, tuple]]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack(order + "I", data[4:8])
    seen: set[int] = set()
    while at:
        if at in seen:
            raise ValueError("the chain of directories has a loop")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags = {"order": order}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind in KINDS:
                size = struct.calcsize(KINDS[kind]) * count
                place = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
                tags[tag] = struct.unpack_from(f"{order}{count}{KINDS[kind]}", data, place)
        yield tags
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def _samples(data: bytes, tags: dict) -> np.ndarray:
    """Height x width x samples of one page."""
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    bits = one(BITS, 1)
    if bits not in (8, 16):
        raise ValueError(f"{bits} bits a sample are not supported")
    kind = np.dtype(np.uint8 if bits == 8 else tags["order"] + "u2")
    compression, predictor, planar = one(COMPRESSION, NONE), one(PREDICTOR, 1), one(PLANAR, 1) == 2
    planes, depth = (samples, 1) if planar else (1, samples)
    if height * width * samples * kind.itemsize > EXPANSION * len(data):
        raise ValueError(f"a page of {height} x {width} x {samples} samples can't be in {len(data)} bytes")
    tiled = TILE_WIDTH in tags
    w, h = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    offsets, sizes = tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_SIZES if tiled else STRIP_SIZES]
    if w * h * depth * kind.itemsize > EXPANSION * len(data) or planes * -(-height // h) * -(-width // w) != len(offsets):
        raise ValueError("strips or tiles don't make up the page")
    page = np.zeros((height, width, samples), kind)
    places = [(p, y, x) for p in range(planes) for y in range(0, height, h) for x in range(0, width, w)]
    for (plane, y, x), offset, size in zip(places, offsets, sizes, strict=True):
        rows = h if tiled else min(h, height - y)
        raw = _decoded(data[offset : offset + size], compression, rows * w * depth * kind.itemsize)
        block = np.frombuffer(raw, kind, rows * w * depth).reshape(rows, w, depth)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
        elif predictor != 1:
            raise ValueError(f"predictor {predictor} is not supported")
        part = block[: min(rows, height - y), : min(w, width - x)]
        page[y : y + part.shape[0], x : x + part.shape[1], plane : plane + depth] = part
    return page


def pages_of(data: bytes) -> Iterator[dict]:
    """Each page of a file; a fault ends the file with a row that names it."""
    number = 0
    try:
        for tags in _directories(data):
            page = _samples(data, tags)
            yield {
                "page": number,
                "height": page.shape[0],
                "width": page.shape[1],
                "samples": page.shape[2],
                "compression": tags.get(COMPRESSION, (NONE,))[0],
                "predictor": tags.get(PREDICTOR, (1,))[0],
                "tiled": TILE_WIDTH in tags,
                "pixels": page.tobytes(),
                "error": None,
            }
            number += 1
    except (ValueError, KeyError, IndexError, TypeError, struct.error, zlib.error, ZeroDivisionError, OverflowError) as fault:
        empty = dict.fromkeys(("height", "width", "samples", "compression", "predictor", "tiled", "pixels"))
        yield empty | {"page": number, "error": f"{type(fault).__name__}: {fault}"}


def _page_bytes(rows: np.ndarray, scheme: int, at: int) -> tuple[list[bytes], dict[int, tuple]]:
    """Encoded parts of a page and its tags; scheme: 0 deflate, 1 LZW, 2 PackBits, 3 deflate in tiles."""
    height, width = rows.shape
    tags = {WIDTH: (width,), HEIGHT: (height,), BITS: (8,), PHOTOMETRIC: (1,), SAMPLES: (1,)}
    differences = lambda x: np.diff(x, axis=1, prepend=np.zeros((len(x), 1), np.uint8))
    if scheme == 3:
        w, h = TILE
        full = np.zeros((-(-height // h) * h, -(-width // w) * w), np.uint8)
        full[:height, :width] = rows
        parts = [zlib.compress(differences(full[y : y + h, x : x + w]).tobytes(), 1) for y in range(0, len(full), h) for x in range(0, full.shape[1], w)]
        tags |= {TILE_WIDTH: (w,), TILE_HEIGHT: (h,)}
    else:
        strips = [rows[y : y + STRIP_ROWS] for y in range(0, height, STRIP_ROWS)]
        if scheme == 0:
            parts = [zlib.compress(differences(x).tobytes(), 1) for x in strips]
        elif scheme == 1:
            parts = [lzw_encode(x.tobytes()) for x in strips]
        else:
            parts = [b"".join(packbits_encode(row.tobytes()) for row in x) for x in strips]
        tags[ROWS_PER_STRIP] = (STRIP_ROWS,)
    tags[COMPRESSION] = ((DEFLATE, LZW, PACKBITS, DEFLATE)[scheme],)
    if scheme in (0, 3):
        tags[PREDICTOR] = (2,)
    sizes = [len(x) for x in parts]
    offsets = [at + sum(sizes[:k]) for k in range(len(parts))]
    tags |= {TILE_OFFSETS: offsets, TILE_SIZES: sizes} if scheme == 3 else {STRIP_OFFSETS: offsets, STRIP_SIZES: sizes}
    return parts, tags


def write_tiff(payload: bytes, width: int = PAYLOAD_UNIT) -> bytes:
    """A grey 8-bit file of pages of at most 64 rows; compression goes round with the number of rows and the page."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    body, at, links = [b"II*\0"], 8, []
    directories = []
    for number, y in enumerate(range(0, len(rows), PAGE_ROWS)):
        parts, tags = _page_bytes(rows[y : y + PAGE_ROWS], SCHEMES[(len(rows) + number) % len(SCHEMES)], at)
        at += sum(map(len, parts))
        entries, outside = [], b""
        odd = at % 2
        parts += [b"\0"] * odd
        at += odd
        base = at + 2 + 12 * len(tags) + 4
        for tag in sorted(tags):
            values = tags[tag]
            kind = 4 if tag in (STRIP_OFFSETS, STRIP_SIZES, TILE_OFFSETS, TILE_SIZES) else 3
            packed = struct.pack(f"<{len(values)}{KINDS[kind]}", *values)
            if len(packed) > 4:
                place, outside = struct.pack("<I", base + len(outside)), outside + packed
            else:
                place = packed.ljust(4, b"\0")
            entries.append(struct.pack("<HHI", tag, kind, len(values)) + place)
        directories.append((parts, struct.pack("<H", len(tags)) + b"".join(entries), outside))
        links.append(at)
        at = base + len(outside)
    out = [b"II*\0", struct.pack("<I", links[0] if links else 0)]
    for k, (parts, directory, outside) in enumerate(directories):
        out += [*parts, directory, struct.pack("<I", links[k + 1] if k + 1 < len(links) else 0), outside]
    return b"".join(out)


def read_pages(files: DataFrame, content_col: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each page of each file, the pages of a file one after another.

    A null or empty file, and any file that breaks the format, gives a row whose `error` says so,
    after the pages before the fault. A page takes at most EXPANSION times its file's bytes, whatever
    its header says. Repeated files are read each; an empty table gives no row. Columns: `keep` as they
    are (one of the names below is an error), then file_bytes, file_sha256, page, height, width,
    samples, compression, predictor, tiled, pixels, error. Whole numbers of `keep` pass through Python
    as text, as beside a null they would become floats.
    """
    small_batches(files.sparkSession, 4)
    kept = files.select(*keep).schema
    whole = {f.name: f.dataType for f in kept.fields if f.dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")}
    fields = ", ".join(f"`{f.name}` {'string' if f.name in whole else f.dataType.simpleString()}" for f in kept.fields)
    names = ["file_bytes", "file_sha256", "page", "height", "width", "samples", "compression", "predictor", "tiled", "pixels", "error"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for own, data in zip(batch[list(keep)].itertuples(index=False, name=None), batch["_content"]):
                data = data or b""
                digest = hashlib.sha256(data).hexdigest()
                rows += [(*own, len(data), digest, *(page[k] for k in names[2:])) for page in pages_of(data)]
            frame = pd.DataFrame(rows, columns=[*keep, *names])
            for k in ("height", "width", "samples", "compression", "predictor"):
                frame[k] = frame[k].astype("Int32")
            yield frame

    if set(keep) & set(names):
        raise ValueError(f"columns to keep have names of this operator's: {sorted(set(keep) & set(names))}")
    rows = files.select(*(F.col(c).cast("string").alias(c) if c in whole else F.col(c) for c in keep), F.col(content_col).alias("_content")).mapInPandas(        read,
        fields + ", " * bool(keep) + "file_bytes long, file_sha256 string, page int, height int, width int, samples int, "
        "compression int, predictor int, tiled boolean, pixels binary, error string",
    )
    return rows.select(*(F.col(c).cast(whole[c]).alias(c) if c in whole else F.col(c) for c in keep), *names)


def texts_as_tiff(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every whole text as a TIFF file: the id, n_bytes, content.

    Null counts as empty; padding is byte 255. Long texts have more pages. Repeated rows give a file
    each, equal texts equal files; an empty table gives no row; other columns are not read.
    """

    def write(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            payloads = [(text or "").encode("utf-8", "replace") for text in texts]
            files = [write_tiff(x + b"\xff" * (-len(x) % PAYLOAD_UNIT or PAYLOAD_UNIT * (not x))) for x in payloads]
            yield pd.DataFrame({"n_bytes": [len(x) for x in payloads], "content": files})

    small_batches(docs.sparkSession, 4)
    return beside(docs, id_col, text_col, write, "n_bytes long, content binary")


def feature_of(payload: bytes) -> str:
    """Mean sample and a 64-bit hash: which of 64 equal stretches are brighter than the mean."""
    samples = np.frombuffer(payload, np.uint8).astype(np.int64)
    means = np.add.reduceat(samples, np.arange(64) * len(samples) // 64) / np.diff(np.arange(65) * len(samples) // 64)
    bits = "".join("1" if x else "0" for x in means > samples.mean())
    return f"{samples.mean():.6f}:{int(bits, 2):016x}"


def op4_tiff(spark, sf_dir: str) -> DataFrame:
    """Digests of what the pages hold; pages of a file follow each other, so a file is put together as they stream by."""
    files = texts_as_tiff(table(spark, sf_dir, "documents")).withColumn("doc_id", F.col("doc_id").cast("string"))
    pages = read_pages(files, keep=("doc_id", "n_bytes"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, parts, rows = None, [], []

        def close() -> None:
            if head is not None:
                payload = b"".join(parts)
                rows.append((head[0], int(head[1]), *head[2:], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), feature_of(payload), len(parts)))

        def out() -> pd.DataFrame:
            frame = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "media_bytes", "media_sha256", "payload_bytes", "payload_sha256", "tail_crc32", "feature", "pages"])
            rows.clear()
            return frame

        for batch in batches:
            columns = ("doc_id", "n_bytes", "file_bytes", "file_sha256", "page", "pixels", "error")
            for doc, n, size, digest, page, pixels, error in zip(*(batch[c] for c in columns)):
                if error is not None:
                    raise ValueError(f"document {doc} could not be read back: {error}")
                if page == 0:
                    close()
                    head, parts = (doc, n, size, digest), []
                parts.append(pixels)
            yield out()
        close()
        yield out()

    found = pages.mapInPandas(
        fold,
        "doc_id string, n_bytes long, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string, pages int",
    )
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))
