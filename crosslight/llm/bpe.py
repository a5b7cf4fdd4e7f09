"""BPE encoding and decoding through a table of distinct words.

Three Spark steps: (1) every block of documents (one input partition) gives its distinct words;
(2) the words are dealt out by the word itself, so each one meets in one task and is encoded there
once, and the word's ids go back to the blocks that hold it; (3) each block's documents meet the
block's words and ids are joined back by position. Decoding joins the distinct ids of each block with
the table of the vocabulary's pieces, and a document's ids then take their pieces from its block's.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, tidied

# The white space, and the steps of a tokenizer's file that this module carries out.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words whose ids a task keeps.
KNOWN_WORDS = 80_000
#: Input bytes of a block, which bounds the words that a task keeps.
BLOCK_BYTES = 1 << 24
#: Documents that a task hands on at once.
ROWS_OUT = 256
ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
ANY_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")


def special_tokens(tokenizer_path: str) -> dict[str, int]:
    """Special tokens of the tokenizer's file and their ids. A file of another kind than this module works by is an error."""
    model = json.load(open(tokenizer_path, encoding="utf-8"))
    steps = (model["pre_tokenizer"] or {}).get("pretokenizers", [])
    words = steps and steps[0].get("type") == "Split" and steps[0]["pattern"] == {"Regex": WORDS} and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
    whole = words and len(steps) == 2 and steps[1]["type"] == "ByteLevel" and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
    plain = all(x["special"] and not (x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"]) for x in model["added_tokens"])
    if model["model"]["type"] != "BPE" or (model["normalizer"] or {}).get("normalizers") != NORMALIZERS or not whole or not plain or model["decoder"] or model["post_processor"]:
        raise ValueError(f"{tokenizer_path} normalises, splits or decodes text in another way than this operator does")
    return {x["content"]: x["id"] for x in model["added_tokens"]}


@lru_cache(maxsize=8)
def _special(tokens: tuple[str, ...]) -> re.Pattern:
    return re.compile("(" + "|".join(map(re.escape, tokens)) + ")" if tokens else "((?!))")


def split_words(text: str | None, special: tuple[str, ...]) -> list[str]:
    """Words of a whole text in order, as the tokenizer's normaliser and pattern give them; special tokens are words of their own."""
    if not text:
        return []
    out: list[str] = []
    for part in _special(special).split(text) if any(x in text for x in special) else (text,):
        if part in special:
            out.append(part)
        elif part.isascii():
            out += ASCII_WORD.findall(part.lower())
        else:
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            out += ANY_WORD.findall(part)
    return out


def _pack(block: int, ids_of: dict[str, bytes], words: list[str]) -> tuple:
    """Words and ids of one block as one compressed row; in sorted order neighbours share their beginnings."""
    import zstandard

    words = sorted(words)
    ids = [ids_of[w] for w in words]
    counts = np.fromiter(map(len, ids), dtype="<u4", count=len(ids)) // 4
    shrink = zstandard.ZstdCompressor(level=6).compress
    return block, shrink(" ".join(words).encode()), shrink(counts.astype("<u4").tobytes() + b"".join(ids)), len(ids)


@lru_cache(maxsize=None)
def _number(token: int) -> str:
    """An id as text; there are no more of them than the vocabulary has, and each is kept once."""
    return str(token)


def _unpack(words: bytes, ids: bytes, n: int) -> Iterator[tuple[str, str]]:
    """Each word with its ids as text, joined by spaces."""
    import zstandard

    grow = zstandard.ZstdDecompressor().decompress
    data = grow(ids)
    numbers = [_number(x) for x in np.frombuffer(data, "<u4", offset=4 * n).tolist()]
    at = 0
    for word, count in zip(grow(words).decode().split(" "), np.frombuffer(data, "<u4", n).tolist()):
        yield word, " ".join(numbers[at : at + count])
        at += count


def block_of(docs: DataFrame, text_col: str) -> F.Column:
    """Blocks of about BLOCK_BYTES of input: the input partition, and a hash of the text where partitions are larger."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)i?b?", docs.sparkSession.conf.get("spark.sql.files.maxPartitionBytes").strip().lower()).groups()
    parts = max(1, int(number) * 1024 ** " kmgt".index(unit or " ") // BLOCK_BYTES)
    return (F.spark_partition_id() * parts + F.pmod(F.xxhash64(F.coalesce(text_col, F.lit(""))), F.lit(parts))).cast("int")


def word_blocks(docs: DataFrame, text_col: str, special: tuple[str, ...]) -> DataFrame:
    """Distinct words of each block: word, block."""

    @tidied
    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, set[str]] = {}
        for batch in batches:
            for block, texts in batch.groupby("block")["text"]:
                own, new = seen.setdefault(block, set()), set()
                for text in texts:
                    new.update(split_words(text, special))
                new -= own
                own |= new
                if new:
                    yield pd.DataFrame({"word": list(new), "block": np.int32(block)})

    return docs.select(F.col(text_col).alias("text"), block_of(docs, text_col).alias("block")).mapInPandas(distinct, "word string, block int")


def encode_words(pairs: DataFrame, tokenizer_path: str, special: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """Each distinct word is encoded once, in the task to which its hash sends it.

    Rows packed for each block (block, words, ids, n), and the distinct ids of each block (block, token).
    The two are taken from the same shuffle of words; to keep the packed rows for both would cost more disk.
    """

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, dict[str, bytes]]]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads of its own would each keep memory
        from tokenizers import Tokenizer, pre_tokenizers

        whole = Tokenizer.from_file(tokenizer_path)
        plain = Tokenizer(whole.model)  # words are normalised and split already
        plain.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        known: dict[str, bytes] = {}  # ids as 32-bit numbers
        for batch in batches:
            if len(known) > KNOWN_WORDS:
                known.clear()
            fresh = [w for w in set(batch["word"]) if w not in known]
            for word, found in zip(fresh, plain.encode_batch_fast(fresh, add_special_tokens=False)):
                known[word] = np.array(found.ids, "<u4").tobytes()
            for word in fresh:
                if word in special:
                    known[word] = np.array([special[word]], "<u4").tobytes()
            yield batch, known

    @tidied
    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, known in coded(batches):
            rows = [_pack(block, known, group.tolist()) for block, group in batch.groupby("block")["word"]]
            yield pd.DataFrame(rows, columns=["block", "words", "ids", "n"])

    @tidied
    def used(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, np.ndarray] = {}
        for batch, known in coded(batches):
            for block, words in batch.groupby("block")["word"]:
                new = np.unique(np.frombuffer(b"".join(map(known.__getitem__, words)), "<u4"))
                before = seen.get(block, new[:0])
                seen[block] = np.union1d(before, new)
        yield pd.DataFrame({"block": np.fromiter(seen, np.int32, len(seen)), "tokens": [x.tobytes() for x in seen.values()]})

    def distinct(rows: pd.DataFrame) -> pd.DataFrame:
        """The ids of a block from all tasks, no more of them than the vocabulary has."""
        tokens = np.unique(np.frombuffer(b"".join(rows["tokens"]), "<u4"))
        return pd.DataFrame({"block": rows["block"].iloc[0], "token": tokens.astype(np.int32)})

    dealt = pairs.repartition("word")
    tokens = dealt.mapInPandas(used, "block int, tokens binary").groupBy("block").applyInPandas(distinct, "block int, token int")
    return dealt.mapInPandas(packed, "block int, words binary, ids binary, n int"), tokens


def vocabulary(spark: SparkSession, tokenizer_path: str) -> DataFrame:
    """Every id of the tokenizer's file with its piece: token, piece; a row for each, of the file's size."""
    model = json.load(open(tokenizer_path, encoding="utf-8"))
    pairs = [(i, piece) for piece, i in model["model"]["vocab"].items()] + [(x["id"], x["content"]) for x in model["added_tokens"]]
    return spark.createDataFrame(pd.DataFrame(pairs, columns=["token", "piece"]), "token int, piece string")


def block_pieces(used: DataFrame, pieces: DataFrame) -> DataFrame:
    """The ids of each block joined with their pieces: block, tokens, pieces; no more of them than the vocabulary has."""
    joined = used.join(F.broadcast(pieces), "token").groupBy("block").agg(F.collect_list(F.struct("token", "piece")).alias("found"))
    return joined.select("block", F.transform("found", lambda x: x["token"]).alias("tokens"), F.transform("found", lambda x: x["piece"]).alias("pieces"))


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Token ids and decoded text of every whole text.

    `docs` is read twice and must come from files or a checkpoint, so that both readings deal rows
    out alike; a word that the second reading finds missing raises an error rather than giving a
    wrong result. Null texts count as empty and give no ids. Texts of any length are taken whole.
    Repeated rows are encoded each; an empty table gives no row; columns other than the two named are
    not read. Ids pass through Python as text, as whole numbers beside a null would become floats.

    Columns: the id, n_tokens, and ids (list of int) and decoded (string), or with `digests` instead
    ids_sha256 and decoded_sha256, the digests of the decimal ids joined by a space and of the text.
    """
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    special = special_tokens(tokenizer_path)
    apart = tuple(special)
    coded, used = encode_words(word_blocks(docs, text_col, apart), tokenizer_path, special)

    @tidied
    def pack_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        shrink = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            rows = []
            for block, group in batch.groupby("block"):
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in group["text"]]
                sizes = np.fromiter(map(len, texts), dtype="<u4", count=len(texts))
                rows.append((block, 2, group["id"].tolist(), shrink(b"".join(texts)), sizes.tobytes(), len(texts)))
            yield pd.DataFrame(rows, columns=["block", "kind", "keys", "a", "b", "n"])

    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), block_of(docs, text_col).alias("block")).mapInPandas(
        pack_texts, "block int, kind int, keys array<string>, a binary, b binary, n int"
    )
    words = coded.select("block", F.lit(0).alias("kind"), F.col("words").alias("a"), F.col("ids").alias("b"), "n")
    pieces = block_pieces(used, vocabulary(docs.sparkSession, tokenizer_path)).withColumn("kind", F.lit(1))
    both = texts.unionByName(words, allowMissingColumns=True).unionByName(pieces, allowMissingColumns=True)

    def frame_of(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["_id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"])])

    @tidied
    def join_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        block, ids_of, piece_of = None, {}, {}
        for batch in batches:
            for at, kind, keys, a, b, n, tokens, texts_of in zip(*(batch[c] for c in ("block", "kind", "keys", "a", "b", "n", "tokens", "pieces"))):
                if at != block:
                    block, ids_of, piece_of = at, {}, {}
                if kind == 0:
                    ids_of.update(_unpack(a, b, int(n)))
                    continue
                if kind == 1:
                    piece_of = dict(zip(map(str, tokens), texts_of))
                    continue
                data, out, end = zstandard.ZstdDecompressor().decompress(a), [], 0
                for key, size in zip(keys, np.frombuffer(b, "<u4").tolist()):
                    text, end = data[end : end + size].decode("utf-8", "surrogatepass"), end + size
                    joined = " ".join([ids_of[w] for w in split_words(text, apart)])
                    ids = joined.split()
                    decoded = " ".join([piece_of[i] for i in ids])
                    if digests:
                        out.append((key, len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
                    else:
                        out.append((key, len(ids), np.fromiter(map(int, ids), np.int32, len(ids)), decoded))
                    if len(out) == ROWS_OUT:
                        yield frame_of(out)
                        out = []
                yield frame_of(out)

    kinds = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    found = both.repartition("block").sortWithinPartitions("block", "kind").mapInPandas(join_back, f"_id string, n_tokens long, {kinds}")
    return found.withColumn("_id", F.col("_id").cast(id_type)).withColumnRenamed("_id", id_col)


def decode(coded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Decoded text of lists of ids, by a join of ids with the vocabulary's pieces.

    The vocabulary is a table of one row for each id, of the size of the tokenizer's file, and is
    broadcast. Null lists decode to the empty text; an id outside the vocabulary adds no piece.
    """
    pieces = vocabulary(coded.sparkSession, tokenizer_path)
    keyed = coded.select(F.col(id_col), F.col(ids_col).alias("_ids"), F.monotonically_increasing_id().alias("_row"))
    long = keyed.select(id_col, "_row", F.posexplode_outer("_ids").alias("_at", "token"))
    joined = long.join(F.broadcast(pieces), "token", "left")
    listed = joined.groupBy("_row").agg(F.first(id_col).alias(id_col), F.array_sort(F.collect_list(F.struct("_at", "piece"))).alias("_p"))
    texts = F.filter(F.transform("_p", lambda x: x["piece"]), lambda x: x.isNotNull())
    return listed.select(id_col, F.array_join(texts, " ").alias("decoded"))


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return encode(docs, str(public_tokenizers.path("word_bpe_49k.json")), digests=True)
