"""Language identification by cross-parsing entropy.

A suffix automaton is built of labelled text of each language. A document is parsed against each
automaton from left to right into longest matches; the language whose automaton needs the fewest
phrases for the same letters explains the document best. Letters are read as their UTF-8 bytes, so
all letters of all scripts are told apart by an alphabet of 256.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import beside, small_batches, table
from .labelled import remainder

#: Bounds of what is learned of each language: whole documents, their characters in all, bytes of the reference, characters of a piece of it.
DOCS_PER_LANGUAGE, CHARS_PER_LANGUAGE, REFERENCE, PIECE = 200, 1 << 22, 32_768, 160
#: Texts that are parsed side by side; the rest of the longest ones are parsed one by one.
SIDE_BY_SIDE = 12
MISS = np.uint32(1 << 31)


def plain(text: str) -> str:
    """Lower case, every run of other than letters as one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of each state; state 0 is the empty text, and every path from it is a substring."""
    step, link, length, last = [{}], [-1], [0], 0
    for code in codes:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and code not in step[at]:
            step[at][code] = new
            at = link[at]
        if at >= 0:
            to = step[at][code]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                copy = len(step)
                step.append(dict(step[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                while at >= 0 and step[at].get(code) == to:
                    step[at][code] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
    return step


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(point).isalpha() for point in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=1)
def _tables(texts: tuple[str, ...]) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """Symbol of every byte, number of symbols, all automata as one transition table, and each one's first state.

    Symbols are the bytes that the references have, and one for all others. An entry is the next state
    times the number of symbols; where a match can't go on it is the state after a new phrase's first
    symbol, marked MISS.
    """
    data = [np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) for text in texts]
    used = np.unique(np.concatenate(data))
    symbols = len(used) + 1
    every = np.full(256, symbols - 1, np.uint8 if symbols <= 256 else np.uint16)
    every[used] = np.arange(len(used))
    blocks, roots, base = [], [], 0
    for own in data:
        steps = suffix_automaton(every[own].tolist())
        start = len(steps)  # before any phrase, and after a symbol that the language never has, which is a phrase of its own
        block = np.full((start + 1, symbols), -1, np.int64)
        for state, to in enumerate(steps):
            for code, target in to.items():
                block[state, code] = target
        first = np.where(block[0] >= 0, block[0], start)
        missing = block < 0
        block = (np.where(missing, first, block) + base) * symbols
        blocks.append(block.astype(np.uint32) | (missing.astype(np.uint32) * MISS))
        roots.append((base + start) * symbols)
        base += start + 1
    return every, symbols, np.concatenate(blocks).ravel(), np.array(roots, np.int64)


def letters_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all texts as UTF-8 bytes with one space for each run of anything else, bytes of each text, and whether it has a letter."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), np.array([len(t) for t in lowered], int) + 1)[: len(codes)]
    letter = _letters()[codes]
    keep = np.ones(len(codes), bool)
    keep[1:] = letter[1:] | letter[:-1]  # the joining line break stays with the text before it
    codes, owner, letter = np.where(letter, codes, 32)[keep], owner[keep], letter[keep]
    wide = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
    sizes = np.bincount(owner, wide, len(texts)).astype(np.int64)
    data = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    return np.frombuffer(data, np.uint8), sizes, np.bincount(owner[letter], minlength=len(texts)) > 0


def phrase_counts(texts: list[str], references: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of each whole text under each reference (texts x references), its bytes, and whether it has a letter."""
    every, symbols, steps, roots = _tables(references)
    data, sizes, letters = letters_of(texts)
    codes = every[data]
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    begin, length = starts[order], sizes[order]
    state = np.repeat(roots[:, None], len(order), axis=1).astype(np.uint32)
    phrases = np.zeros((len(roots), len(order)), np.int64)
    # All texts go side by side until few are left; those go on alone, where a step costs less.
    together = int(length[SIDE_BY_SIDE]) if len(order) > SIDE_BY_SIDE else 0
    live = np.searchsorted(-length, -np.arange(together), side="left")
    for t in range(together):
        n = live[t]
        to = steps[state[:, :n] + codes[begin[:n] + t].astype(np.uint32)]
        phrases[:, :n] += to >> 31
        state[:, :n] = to & ~MISS
    view, miss = memoryview(steps), int(MISS)
    for i in range(min(SIDE_BY_SIDE, len(order))):
        rest = codes[begin[i] + together : begin[i] + length[i]].tolist()
        for k in range(len(roots)):
            at, n = int(state[k, i]), 0
            for code in rest:
                at = view[at + code]
                if at >= miss:
                    at, n = at - miss, n + 1
            phrases[k, i] += n
    out = np.zeros((len(texts), len(roots)), np.int64)
    out[order] = phrases.T
    return out, sizes, letters


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, str]:
    """Reference text of each language, from the documents that come first by a hash of their text.

    At most DOCS_PER_LANGUAGE whole texts a language, of CHARS_PER_LANGUAGE characters in all, are
    fetched; longer texts are passed over. Pieces spread evenly over all of these texts make the
    reference of REFERENCE bytes, so memory grows with the number of languages, by some 30 MB each.
    Rows without language or letters are left out.
    """
    usable = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    first = Window.partitionBy("lang").orderBy("hash", "text")
    ranked = usable.where(F.length("text") <= CHARS_PER_LANGUAGE).select("lang", F.xxhash64("text").alias("hash"), "text")
    ranked = ranked.withColumn("n", F.row_number().over(first)).where(F.col("n") <= DOCS_PER_LANGUAGE)
    rows = ranked.withColumn("total", F.sum(F.length("text")).over(first)).where(F.col("total") <= CHARS_PER_LANGUAGE).select("lang", "text", "n").collect()
    by: dict[str, list[str]] = {}
    for lang, text, _ in sorted(rows, key=lambda r: (r[0], r[2])):
        by.setdefault(lang, []).append(plain(text))
    out = {}
    for lang, texts in sorted(by.items()):
        pieces = [t[a : a + PIECE] for t in texts for a in range(0, len(t), PIECE)]
        every = max(1.0, sum(len(p.encode("utf-8", "surrogatepass")) for p in pieces) / REFERENCE)
        out[lang] = " ".join(pieces[int(k * every)] for k in range(int(len(pieces) / every)))
    return out


def predict(docs: DataFrame, references: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of every whole text: the id, lang_pred, score, phrases (of the language) and symbols.

    The score is one less the ratio of the fewest phrases to the second fewest, so 0 for a tie, which
    goes to the language that sorts first; 1 where only one language was learned. Null texts, texts
    without a letter, and every text where nothing was learned get `und` and 0. Repeated rows are
    predicted each, and texts of any length are parsed whole; an empty table gives no row; other
    columns are not read. The references have a fixed bound for each language and go with the tasks.
    """
    small_batches(docs.sparkSession)
    names, texts_of = list(references), tuple(references.values())

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t or "" for t in batch]
            n = len(texts)
            lang, score, least, size = np.full(n, "und", object), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
            if names and n:
                counts, size, letters = phrase_counts(texts, texts_of)
                best = counts.argmin(axis=1)
                least = counts[np.arange(n), best]
                if len(names) > 1:
                    second = np.partition(counts, 1, axis=1)[:, 1]
                    score = np.where(letters, 1 - least / np.maximum(second, 1), 0.0)
                else:
                    score = letters.astype(float)
                lang = np.where(letters, np.array(names, object)[best], "und")
            yield pd.DataFrame({"lang_pred": lang, "score": score, "phrases": least, "symbols": size})

    return beside(docs, id_col, text_col, run, "lang_pred string, score double, phrases long, symbols long")


def op10_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 3) == 1
    return predict(docs, learn(docs.where(~held_out))).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "phrases", "symbols")
