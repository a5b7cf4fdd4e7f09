"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text; where it is small at the start of a word, a chunk ends.
Where no blank follows for long, as in scripts without them, any character may start a chunk.
As the hash sees only the last few bytes, an insertion moves no boundary beyond itself, and a passage
that stands in many documents is cut alike in all of them. Chunks are counted by digest; of equal
chunks the first in the table's order is kept, and runs of later ones are taken out of their texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table, tidied

#: A chunk ends before one word of so many on average; the hash sees this many bytes.
WORDS_A_CHUNK, WINDOW = 5, 16
#: Runs of repeated chunks of fewer words stay: common phrases are no copied passages.
LEAST_WORDS = 16
#: Where no blank is among the next so many bytes, a chunk may end before any character: one of so many on average.
FAR, CHARS_A_CHUNK = 64, 10
#: There so many bytes count as a word, on top of those that blanks part.
BYTES_A_WORD = 6
#: `at` of the rows that stand for a whole text of few words.
WHOLE = 1 << 40
GEAR = np.random.default_rng(20).integers(1, 1 << 32, 256, dtype=np.uint32)
GEAR[0] = 0  # the bytes between two texts of a batch add nothing
GAP = b"\0" * WINDOW
#: Bytes that are hashed at once.
SLICE = 1 << 18


def blanks_of(data: np.ndarray) -> np.ndarray:
    """Bytes of blanks: ASCII's with the control characters, and Unicode's white space."""
    out = data <= 32
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    if not len(lead):
        return out
    padded = np.r_[data, np.zeros(2, np.uint8)]
    a, b, c = padded[lead], padded[lead + 1], padded[lead + 2]
    two = lead[(a == 0xC2) & ((b == 0x85) | (b == 0xA0))]
    three = (a == 0xE1) & (b == 0x9A) & (c == 0x80)
    three |= (a == 0xE2) & (b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    three |= ((a == 0xE2) & (b == 0x81) & (c == 0x9F)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    three = lead[three]
    out[np.concatenate([two, two + 1, three, three + 1, three + 2])] = True
    return out


def rolled_below(data: np.ndarray, limit: int) -> np.ndarray:
    """Where the gear hash of the last WINDOW bytes is below a limit; hashed slice by slice, as they take four times the bytes."""
    out = np.zeros(len(data), bool)
    for at in range(0, len(data), SLICE):
        begin = max(0, at - WINDOW)
        gear, width = GEAR[data[begin : at + SLICE]], 1
        while width < WINDOW:  # sums over 1, 2, 4, ... bytes, older ones shifted up by two bits each
            wider = gear.copy()
            wider[width:] += gear[:-width] << np.uint32(2 * width)
            gear, width = wider, 2 * width
        out[at : at + SLICE] = gear[at - begin :] < np.uint32(limit)
    return out


def chunks_of(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All chunks of some texts: the texts joined, each chunk's text, start in it, end and words."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.r_[0, np.cumsum(sizes + WINDOW)[:-1]] if len(texts) else np.zeros(0, np.int64)
    joined = GAP.join(texts)
    data = np.frombuffer(joined, np.uint8)
    space = blanks_of(data)
    word = ~space
    word[1:] &= space[:-1]
    ends = np.zeros(len(data), bool)
    ends[1:] = word[1:] & rolled_below(data, (1 << 32) // WORDS_A_CHUNK)[:-1]
    at = np.flatnonzero(space)
    # Bytes with no blank among the next FAR; the gap after a text counts as blanks.
    gaps = np.diff(np.r_[-1, at, len(data)])
    wide = np.flatnonzero(gaps > FAR)
    dense = np.zeros(len(data), bool)
    for a, b in zip(np.r_[-1, at][wide] + 1, np.r_[at, len(data)][wide] - FAR):
        dense[a:b] = True
    if len(wide):
        ends[1:] |= dense[1:] & ((data[1:] & 0xC0) != 0x80) & rolled_below(data, (1 << 32) // CHARS_A_CHUNK)[:-1]
    ends[begins[sizes > 0]] = True
    starts = np.flatnonzero(ends)
    owner = np.searchsorted(begins, starts, side="right") - 1
    if len(texts):
        # Empty texts share their begin with the gap; the chunk belongs to the last text that begins there.
        last = np.r_[owner[1:] != owner[:-1], True] if len(owner) else np.zeros(0, bool)
        stops = np.where(last, begins[owner] + sizes[owner], np.r_[starts[1:], 0] if len(starts) else starts)
    else:
        stops = starts
    counts = np.add.reduceat(word, starts, dtype=np.int32) if len(starts) else np.zeros(0, np.int32)
    if len(wide):
        counts = counts + np.add.reduceat(dense, starts, dtype=np.int32) // BYTES_A_WORD
    return joined, owner, starts, stops, counts


def chunk_rows(docs: DataFrame, text_col: str, least_words: int = LEAST_WORDS) -> DataFrame:
    """A row for each chunk: hi, lo (digest), row, at. A chunk that stands earlier in its own text has -1 - at.

    A text of fewer than `least_words` words has a row as a whole too, under a digest of its own kind and with at = WHOLE.
    """

    @tidied
    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch["text"]]
            joined, owner, starts, stops, counts = chunks_of(texts)
            view = memoryview(joined)
            digests = [xxh3_128_digest(view[a:b]) for a, b in zip(starts.tolist(), stops.tolist())]
            pair = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
            first = np.r_[True, owner[1:] != owner[:-1]] if len(owner) else np.zeros(0, bool)
            at = starts - np.maximum.accumulate(np.where(first, starts, 0)) if len(owner) else starts
            rows = batch["row"].to_numpy()[owner] if len(owner) else np.zeros(0, np.int64)
            out = pd.DataFrame({"hi": pair[:, 0], "lo": pair[:, 1], "row": rows, "at": at})
            out["at"] = np.where(out.duplicated(["row", "hi", "lo"]), -1 - at, at)
            yield out
            total = np.bincount(owner, counts, len(texts)) if len(owner) else np.zeros(len(texts))
            short = [k for k, text in enumerate(texts) if text and total[k] < least_words]
            if short:
                pair = np.frombuffer(b"".join(xxh3_128_digest(texts[k], seed=1) for k in short), ">i8").reshape(-1, 2).astype(np.int64)
                yield pd.DataFrame({"hi": pair[:, 0], "lo": pair[:, 1], "row": batch["row"].to_numpy()[short], "at": WHOLE})

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    return rows.mapInPandas(cut_up, "hi long, lo long, row long, at long")


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """Chunks that stand earlier in the table: row, at, of (the document of the first)."""
    chunks = chunk_rows(docs, text_col, least_words)
    firsts = chunks.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.min("row").alias("first")).where("n > 1").select("hi", "lo", "first")
    again = chunks.join(firsts, ["hi", "lo"]).where("row <> first OR at < 0").select("row", F.when(F.col("at") < 0, -1 - F.col("at")).otherwise(F.col("at")).alias("at"), "first")
    owners = docs.select(F.monotonically_increasing_id().alias("first"), F.col(id_col).alias("of"))
    return again.join(owners, "first").select("row", "at", "of")


def kept_text(text: str, found: dict[int, object], least_words: int) -> tuple[str, int, list[tuple[int, int]], list]:
    """A text without its runs of repeated chunks of at least `least_words` words; bytes taken out, their spans, whose they repeat.

    `found` has the starts of repeated chunks and whose they repeat; where they end follows from the text.
    A short text that an earlier one equals goes as a whole.
    """
    data = text.encode("utf-8", "surrogatepass")
    if WHOLE in found:
        return "", len(data), [(0, len(data))], [] if found[WHOLE] is None else [found[WHOLE]]
    _, _, starts, stops, counts = chunks_of([data])
    spans, owners, run = [], set(), []

    def close() -> None:
        if sum(x[2] for x in run) >= least_words:
            spans.append((run[0][0], run[-1][1]))
            owners.update(found[x[0]] for x in run if found[x[0]] is not None)
        run.clear()

    for chunk in zip(starts.tolist(), stops.tolist(), counts.tolist()):
        if chunk[0] in found:
            run.append(chunk)
        else:
            close()
    close()
    out, end = [], 0
    for a, b in spans:
        out.append(data[end:a])
        end = b
    out.append(data[end:])
    kept = b"".join(out)
    return kept.decode("utf-8", "surrogatepass"), len(data) - len(kept), spans, sorted(owners)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of `docs` with repeated passages taken out of their texts.

    Of equal passages the first in the table's order stays, so of exact copies the first keeps its
    text and the others end up empty; no row is dropped. Null and empty texts stay as they are, texts of
    any length are cut whole, and an empty table gives no row. `docs` is read more than once and must
    come from files or a checkpoint. Three columns are added, or replaced where
    `docs` has them: removed_bytes, removed_spans (UTF-8 byte offsets in the old text), repeats_of
    (ids of the documents that hold what was taken out first; null ids are left out).
    """
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    per_row = repeated_chunks(docs, id_col, text_col, least_words).groupBy("row").agg(F.collect_list(F.struct("at", "of")).alias("found"))
    own = [c for c in docs.columns if c not in ("removed_bytes", "removed_spans", "repeats_of")]
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*own).alias("doc"))
    joined = numbered.join(per_row, "row", "left")

    @F.pandas_udf(f"text string, removed_bytes long, removed_spans array<struct<start:int,end:int>>, repeats_of array<{id_type}>")
    @tidied
    def rewrite(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, found in batches:
            rows = [(text, 0, [], []) if text is None or x is None else kept_text(text, {y["at"]: y["of"] for y in x}, least_words) for text, x in zip(texts, found)]
            rows = [(a, b, [{"start": s, "end": e} for s, e in c], d) for a, b, c, d in rows]
            yield pd.DataFrame(rows, columns=["text", "removed_bytes", "removed_spans", "repeats_of"])

    done = joined.select("doc", rewrite(F.col(f"doc.{text_col}"), "found").alias("new"))
    return done.select(
        *[F.col("new.text").alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c) for c in own], "new.removed_bytes", "new.removed_spans", "new.repeats_of"
    )


def op7_substrings(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "text", "removed_bytes", "removed_spans", "repeats_of")
