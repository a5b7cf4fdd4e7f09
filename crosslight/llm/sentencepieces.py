"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised by the longest prefixes that the model's compiled character map holds. For every
byte of the normalised text that step records the byte of the original which it comes from. Pieces are
merged over the normalised text, and the record projects each of them to the span of original bytes.

No merge crosses two characters that stand side by side in no piece of the vocabulary, so a text falls
into parts that are merged apart. A task merges the distinct parts of a batch side by side, one pair of
each in every round, and each part once as long as it remembers it.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, release, small_batches, table

# Fixed values of the format: the sign for a space, the one for unreadable bytes, and the kinds of pieces.
SPACE, UNREADABLE = "▁", "�"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Parts whose pieces a task remembers; workers outlive their tasks, so this bounds what each one keeps.
KNOWN_PARTS = 120_000
#: Characters of a part up to which parts are merged side by side; longer ones are merged one by one and not remembered.
LONG_PART = 64


def proto(data: bytes) -> Iterator[tuple[int, object]]:
    """Numbers and raw values of a protocol buffer's fields."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, data[at : at + size]
        at += size


class CharacterMap:
    """A compiled character map: a double array of prefixes, then the texts that replace them, each ended by a zero byte."""

    def __init__(self, data: bytes):
        size = struct.unpack_from("<I", data)[0]
        self.units = np.frombuffer(data, "<u4", size // 4, 4).tolist()
        self.texts = data[4 + size :]

    @staticmethod
    def _step(unit: int) -> int:
        """How far the units that follow this one lie from it; the format stores large distances by eights of bits."""
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest prefix of data[at:] that the map holds."""
        units, found = self.units, None
        place = self._step(units[0])
        for end in range(at, len(data)):
            place ^= data[end]
            if place >= len(units) or units[place] & 0x800000FF != data[end]:
                break
            unit = units[place]
            place ^= self._step(unit)
            if unit >> 8 & 1:  # a prefix ends here; its value is where its replacement begins
                start = units[place] & 0x7FFFFFFF
                found = end + 1 - at, self.texts[start : self.texts.index(b"\0", start)]
        return found


class Merges:
    """Which two symbols merge, for whole arrays at once. Symbols are ids of pieces, and numbers above them for characters that are none."""

    NEVER = np.iinfo(np.int32).max
    #: Slots of the table of pairs, and an odd number that spreads keys over them.
    SLOT_BITS, MIX = 20, 0x1E3779B97F4A7C15

    def __init__(self, ids: dict[str, int], scores: dict[str, float], n_ids: int):
        self.number = dict(ids)
        for piece in ids:
            for char in piece:
                self.number.setdefault(char, n_ids + len(self.number))
        self.other = n_ids + len(self.number) + 1  # for all characters that stand in no piece
        ranks = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        found = {}
        for piece, whole in ids.items():
            for k in range(1, len(piece)):
                left, right = self.number.get(piece[:k]), self.number.get(piece[k:])
                if left is not None and right is not None:
                    found[left << 32 | right] = (ranks[scores[piece]], whole)
        self.keys = np.array(sorted(found) or [-1], np.int64)
        self.values = np.array([found[k] for k in self.keys.tolist()] if found else [(0, 0)], np.int32)
        self.slots = np.full(1 << self.SLOT_BITS, -1, np.int32)  # the place of a pair that falls into a slot; where several do, the others are searched for
        self.slots[self._slot(self.keys)] = np.arange(len(self.keys), dtype=np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * self.MIX >> (64 - self.SLOT_BITS)) & ((1 << self.SLOT_BITS) - 1)

    def rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How early each pair is merged, and into which piece; NEVER for those that aren't."""
        keys = left.astype(np.int64) << 32 | right
        at = self.slots[self._slot(keys)]
        taken = np.nonzero((at >= 0) & (self.keys[at] != keys))[0]
        at[taken] = np.minimum(np.searchsorted(self.keys, keys[taken]), len(self.keys) - 1)
        hit = (at >= 0) & (self.keys[at] == keys)
        return np.where(hit, self.values[at, 0], self.NEVER), self.values[at, 1]

    def run(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that the parts end with, one part after the other, and how many each has. In every round each part merges its best pair, of equal ones the leftmost."""
        number, other = self.number, self.other
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        symbols = np.array([number.get(c, other) for c in "".join(parts)], np.int32)
        ranks, into = self.rank(symbols, np.append(symbols[1:], -1))
        ranks[np.cumsum(lengths) - 1] = self.NEVER  # no pair across two parts
        owners, done = np.arange(len(parts)), []
        while len(owners):
            starts = np.cumsum(lengths) - lengths
            best = np.minimum.reduceat(ranks.astype(np.int64) << 32 | np.arange(len(ranks)), starts)
            at, goes_on = best & 0xFFFFFFFF, best >> 32 != self.NEVER
            kept = np.repeat(goes_on, lengths)
            if not goes_on.all():
                done.append((owners[~goes_on], lengths[~goes_on], symbols[~kept]))
            at = at[goes_on]
            symbols[at] = into[at]
            kept[at + 1] = False
            ends = np.zeros(len(symbols), bool)
            ends[starts + lengths - 1] = True
            ends[at] |= ends[at + 1]
            moved = np.cumsum(kept) - 1
            at, first = moved[at], moved[starts[goes_on]]
            symbols, ranks, into, ends = symbols[kept], ranks[kept], into[kept], ends[kept]
            owners, lengths = owners[goes_on], lengths[goes_on] - 1
            for place in (at[at > first] - 1, at):
                last = ends[place]
                ranks[place], into[place] = self.rank(symbols[place], symbols[np.minimum(place + 1, len(symbols) - 1)])
                ranks[place[last]] = self.NEVER
        counts = np.zeros(len(parts), np.int64)
        for own, own_lengths, _ in done:
            counts[own] = own_lengths
        out, begins = np.zeros(int(counts.sum()), np.int32), np.cumsum(counts) - counts
        for own, own_lengths, own_symbols in done:
            inside = np.arange(len(own_symbols)) - np.repeat(np.cumsum(own_lengths) - own_lengths, own_lengths)
            out[np.repeat(begins[own], own_lengths) + inside] = own_symbols
        return out, counts


@dataclass
class Model:
    """What encoding and decoding need of a model's file."""

    ids: dict[str, int]  # normal pieces
    scores: dict[str, float]
    bytes_of: list[bytes]  # what an id stands for in decoded text; spaces are spaces
    kinds: list[int]
    byte_ids: list[int]
    pairs: set[str]  # characters that stand side by side in a piece
    split: re.Pattern  # what finds parts of a normalised text that no merge crosses
    merges: Merges
    map: CharacterMap | None
    dummy_prefix: bool
    trim: bool
    sizes: np.ndarray  # bytes that an id covers of the normalised text
    numbers: list[str]  # ids as text
    known: dict[str, tuple[str, bytes, bytes]] = field(default_factory=dict)


@lru_cache(maxsize=2)
def model_of(data: bytes) -> Model:
    """Reads a model. One that doesn't merge pairs, knows no bytes, or has pieces of the user's is of another kind, and an error."""
    pieces, trainer, normalizer = [], {}, {}
    for key, value in proto(data):
        if key == 1:
            piece = dict(proto(value))
            pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, bytes(4)))[0], piece.get(3, NORMAL)))
        elif key == 2:
            trainer = dict(proto(value))
        elif key == 3:
            normalizer = dict(proto(value))
    kinds = [kind for _, _, kind in pieces]
    other = not set(kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE} or kinds.count(BYTE) != 256
    if trainer.get(3) != 2 or trainer.get(24, 0) or not normalizer.get(5, 1) or other:
        raise ValueError("this operator reads models that merge pairs of pieces, fall back to bytes, mark spaces in front, and have no pieces of the user's own")
    ids, scores, bytes_of, byte_ids = {}, {}, [], [0] * 256
    for number, (piece, score, kind) in enumerate(pieces):
        if kind == NORMAL:
            ids[piece], scores[piece] = number, score
            bytes_of.append(piece.replace(SPACE, " ").encode())
        elif kind == BYTE:
            byte_ids[int(piece[3:5], 16)] = number
            bytes_of.append(bytes([int(piece[3:5], 16)]))
        else:
            bytes_of.append(trainer.get(44, b" \xe2\x81\x87 ") if kind == UNKNOWN else b"")
    pairs = {piece[k : k + 2] for piece in ids for k in range(len(piece) - 1)}
    compiled = normalizer.get(2, b"")
    merges = Merges(ids, scores, len(pieces))
    lone = "".join(c for c in "\n\r\t" if c not in merges.number)  # stand in no piece
    parts = f"{SPACE}+[^{SPACE}{lone}]*|[^{SPACE}{lone}]+" + (f"|[{lone}]" if lone else "")
    if any(p[1] == SPACE and p[0] != SPACE for p in pairs):
        parts = "(?s:.+)"  # pieces may go on from another character into a sign
    return Model(ids, scores, bytes_of, kinds, byte_ids, pairs, re.compile(parts), merges, CharacterMap(compiled) if compiled else None, bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1)), np.array([len(p.encode()) for p, _, _ in pieces], np.int32), list(map(str, range(len(pieces) + 1))))


def normalise(text: str, model: Model) -> tuple[str, np.ndarray]:
    """The normalised text, and for each of its bytes the original byte it comes from, with the original's end at last.

    A space becomes the sign for one. All bytes of a replacement come from where the replaced prefix begins.
    """
    data = text.encode()
    if model.map is None and not model.trim:
        if not data:
            return "", np.zeros(1, np.int32)
        each = np.frombuffer(data, np.uint8)
        source = np.repeat(np.arange(len(each), dtype=np.int32), np.where(each == 32, 3, 1))
        prefix = SPACE if model.dummy_prefix else ""
        return prefix + text.replace(" ", SPACE), np.concatenate([np.zeros(3 * len(prefix), np.int32), source, np.array([len(data)], np.int32)])
    return _normalise_by_map(data, model)


def _normalise_by_map(data: bytes, model: Model) -> tuple[str, np.ndarray]:
    parts, source, at = [], [], 0

    def prefix(at: int) -> tuple[int, bytes]:
        found = model.map.longest(data, at) if model.map else None
        if found:
            return found
        first = data[at]
        size = 1 if first < 128 else 2 if first < 224 else 3 if first < 240 else 4
        return size, data[at : at + size]

    sign = SPACE.encode()
    while model.trim and at < len(data):  # leading spaces go
        size, put = prefix(at)
        if put != b" ":
            break
        at += size
    if at == len(data):
        return "", np.array([at], np.int32)
    if model.dummy_prefix:
        parts.append(sign)
        source += [at] * 3
    after_space = model.trim
    while at < len(data):
        size, put = prefix(at)
        put = put.lstrip(b" ") if after_space else put
        if put:
            grown = put.replace(b" ", sign)
            parts.append(grown)
            source += [at] * len(grown)
            after_space = model.trim and put.endswith(b" ")
        at += size
    whole = b"".join(parts)
    while model.trim and whole.endswith(sign):
        whole = whole[:-3]
        at = source[len(whole)]
    return whole.decode("utf-8", "replace"), np.array([*source[: len(whole)], at], np.int32)


def merged(part: str, model: Model) -> list[str]:
    """Pieces of a part: the pair with the best score is merged first, of equal ones the leftmost."""
    scores, symbols = model.scores, list(part)
    n = len(symbols)
    before, after, heap = list(range(-1, n - 1)), [*range(1, n), -1], []

    def offer(left: int, right: int) -> None:
        if left >= 0 and right >= 0:
            score = scores.get(symbols[left] + symbols[right])
            if score is not None:
                heapq.heappush(heap, (-score, left, right, len(symbols[left]) + len(symbols[right])))

    for k in range(n - 1):
        offer(k, k + 1)
    while heap:
        _, left, right, size = heapq.heappop(heap)
        if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != size:
            continue  # one of the two has been merged since
        symbols[left] += symbols[right]
        symbols[right] = ""
        after[left] = after[right]
        if after[right] >= 0:
            before[after[right]] = left
        offer(before[left], left)
        offer(left, after[left])
    return [s for s in symbols if s]


def _parts(segment: str, model: Model) -> list[str]:
    """A long segment cut where two characters meet that no piece holds side by side."""
    cuts = [k for k in range(1, len(segment)) if segment[k - 1 : k + 1] not in model.pairs]
    return [segment[a:b] for a, b in zip([0, *cuts], [*cuts, len(segment)])]


Coded = tuple[str, bytes, bytes]


def _coded(pieces: list[str], model: Model) -> Coded:
    """Ids of pieces as text, the same as 32-bit numbers, and the bytes that each covers of the normalised text.

    A character without a piece becomes its bytes; the last of them covers the character, the others nothing.
    """
    ids, sizes = [], []
    for piece in pieces:
        data, number = piece.encode(), model.ids.get(piece)
        if number is None:
            ids += [model.byte_ids[b] for b in data]
            sizes += [0] * (len(data) - 1) + [len(data)]
        else:
            ids.append(number)
            sizes.append(len(data))
    return ",".join(map(str, ids)), np.array(ids, "<i4").tobytes(), np.array(sizes, "<i4").tobytes()


def code_segments(segments: list[str], model: Model) -> dict[str, Coded]:
    """Ids of distinct segments, each merged once."""
    out, short = {}, [s for s in segments if len(s) <= LONG_PART]
    if short:
        flat, counts = model.merges.run(short)
        strange = np.add.reduceat(flat >= len(model.sizes), np.cumsum(counts) - counts).tolist()
        covered = model.sizes[np.minimum(flat, len(model.sizes) - 1)]
        data, spans, texts, at = flat.astype("<i4").tobytes(), covered.astype("<i4").tobytes(), list(map(model.numbers.__getitem__, np.minimum(flat, len(model.sizes)).tolist())), 0
        for segment, count, odd in zip(short, counts.tolist(), strange):
            end = at + count
            out[segment] = _coded(merged(segment, model), model) if odd else (",".join(texts[at:end]), data[4 * at : 4 * end], spans[4 * at : 4 * end])
            at = end
    for segment in segments:
        if len(segment) > LONG_PART:
            out[segment] = _coded([p for part in _parts(segment, model) for p in merged(part, model)], model)
    return out


Encoded = tuple[str, np.ndarray, np.ndarray, np.ndarray]


def encode_texts(texts: list[str], model: Model) -> Iterator[Encoded]:
    """For each whole text its ids as decimals joined by commas, the ids, and where each one's span of original bytes begins and ends."""
    known = model.known
    cut = [(model.split.findall(whole), source) for whole, source in (normalise(text, model) for text in texts)]
    every = set().union(*(parts for parts, _ in cut))
    fresh = every - known.keys()
    if len(known) + len(fresh) > KNOWN_PARTS:
        for part in known.keys() - every:
            del known[part]
    known.update(code_segments(list(fresh), model))
    for parts, source in cut:
        found = list(map(known.__getitem__, parts))
        ids = np.frombuffer(b"".join([f[1] for f in found]), "<i4")
        ends = np.cumsum(np.frombuffer(b"".join([f[2] for f in found]), "<i4"))
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ids)]
        yield ",".join([f[0] for f in found]), ids, source[starts], source[ends]
    for part in fresh:
        if len(part) > LONG_PART:
            del known[part]


def encode_text(text: str, model: Model) -> Encoded:
    (found,) = encode_texts([text], model)
    return found


def decode_ids(ids: list[int], model: Model) -> str:
    """The text of ids: pieces with spaces for their signs, without the space that encoding put in front, and bytes where they make characters."""
    table, kinds, front = model.bytes_of, model.kinds, 0
    if model.dummy_prefix or model.trim:
        for number in ids:
            if kinds[number] == CONTROL:
                continue
            piece = table[number]
            if kinds[number] == NORMAL and piece.startswith(b" "):
                front += 1
                if model.trim and piece == b" ":
                    continue  # leading spaces all go
            break
    data = b"".join([table[n] for n in ids])
    try:
        return data.decode()[front:]
    except UnicodeDecodeError:
        return _decode_by_runs(ids, model)[front:]


def _decode_by_runs(ids: list[int], model: Model) -> str:
    """As above where bytes make no characters: each such byte becomes the sign for unreadable ones."""
    out, run = [], bytearray()

    def flush() -> None:
        at = 0
        while at < len(run):
            for size in (1, 2, 3, 4):
                try:
                    out.append(bytes(run[at : at + size]).decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                size = 1
                out.append(UNREADABLE)
            at += size
        run.clear()

    for number in ids:
        if model.kinds[number] == BYTE:
            run += model.bytes_of[number]
            continue
        flush()
        out.append(model.bytes_of[number].decode())
    flush()
    return "".join(out)


FIELDS = "n_tokens long, ids array<int>, begins array<int>, ends array<int>, decoded string"
DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string, span_bytes long"


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Ids of every whole text, the original bytes that each id covers, and the text decoded from the ids.

    Each row is taken for itself, so there is no shuffle and repeated rows are encoded each. Null texts
    count as empty; an empty text has no ids. Texts of any length are taken whole. An empty table gives
    no row; columns other than the two named are not read. The model's file is read on the driver and
    goes to the tasks as it is; it is of a fixed size.

    Columns: the id, n_tokens, ids, begins and ends (bytes of the original; a character without a piece
    is covered by the last of its bytes' ids), decoded; with `digests` instead of these lists and texts
    the SHA-256 of the decimal ids joined by commas and of the decoded text, and span_bytes, the bytes
    that the spans cover.
    """
    small_batches(docs.sparkSession)
    with open(model_path, "rb") as file:
        data = file.read()
    model_of(data)  # a model of another kind is an error here, not in a task
    shared = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        release()
        model = model_of(shared.value)
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for texts in batches:
            rows = []
            for joined, ids, begins, ends in encode_texts([text or "" for text in texts], model):
                decoded = decode_ids(ids.tolist(), model)
                if digests:
                    rows.append((len(ids), sha(joined), sha(decoded), int((ends - begins).sum())))
                else:
                    rows.append((len(ids), ids, begins, ends, decoded))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in (DIGESTS if digests else FIELDS).split(", ")])

    return beside(docs, id_col, text_col, run, DIGESTS if digests else FIELDS)


def decode(coded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of lists of ids: the id and `decoded`. Null lists give the empty text; an id outside the vocabulary is an error."""
    with open(model_path, "rb") as file:
        shared = coded.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = model_of(shared.value)
        for lists in batches:
            yield pd.DataFrame({"decoded": [decode_ids([] if x is None else list(x), model) for x in lists]})

    return beside(coded, id_col, ids_col, run, "decoded string")


def op11_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), str(public_tokenizers.path("piece_bpe_32k.model")), digests=True)
