"""Near-duplicates by consistent weighted sampling.

A document is a bag of five-word shingles weighted by TF-IDF. Improved consistent weighted sampling
draws from it samples that two documents share as often as their weighted Jaccard similarity says.
Bands of samples give candidates, which are verified by their exact weighted Jaccard similarity.

Pairs within a bucket are not made. What a document has alone, in shingles that no other candidate
holds, bounds its similarity to all others: most members of a hot bucket drop out by that bound in
one pass. Of the rest, all meet the bucket's cleanest member, which has least of its own. Only members
that are still in different components and may be similar by their bounds are compared further.

A shingle's inverse document frequency is the mean of its words'. The shingle's own would count the
copies that are looked for: the more copies of a text there are, the lighter what they share would
weigh against a few edited words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KNOWN, cut, small_batches, table, tidied, words
from .graphs import components

SHINGLE, SIMILARITY = 5, 0.8
#: A pair of similarity s meets in a band with probability s^ROWS: at 0.8 all bands miss 2 pairs of 10,000.
BANDS, ROWS = 12, 3
#: Words are counted in this many buckets by their hash: the bound of the broadcast table.
BUCKETS = 1 << 20
#: Members, and their weight, of a block of what is left of a bucket; more meet as pairs of blocks.
MEMBERS, WEIGHT = 1_024, 1 << 22
#: Members of a block whose pairs are looked at at once.
STRIP = 64
#: Shingles of a document that are sampled at once.
SLICE = 4_096

_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes(dict):
    """Hash of each word that was asked for, 63 bits."""

    def __missing__(self, token: str) -> int:
        from xxhash import xxh3_64_intdigest

        self[token] = found = xxh3_64_intdigest(token.encode("utf-8", "surrogatepass")) >> 1
        return found


def hashes_of(tokens: list[str], known: Hashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens)).view(np.uint64)


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """Documents with a word of each bucket, over all documents, and the number of documents."""

    @tidied
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, known = np.zeros(BUCKETS + 1, np.int64), Hashes()
        for batch in batches:
            sums[BUCKETS] += len(batch)  # the last place counts documents
            for text in batch["text"]:
                sums[np.unique(hashes_of(words(text or ""), known) % np.uint64(BUCKETS)).astype(np.int64)] += 1
            if len(known) > KNOWN:
                known.clear()
        at = np.flatnonzero(sums)
        yield pd.DataFrame({"bucket": at, "n": sums[at]})

    parts = docs.select(F.col(text_col).alias("text")).mapInPandas(count, "bucket int, n long")
    found = parts.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS + 1 rows at most
    out = np.zeros(BUCKETS + 1, np.int64)
    out[found["bucket"]] = found["n"]
    return out[:BUCKETS], int(out[BUCKETS])


def inverse_frequencies(counts: np.ndarray, n_docs: int) -> np.ndarray:
    return (np.log((n_docs + 1) / (counts + 1)) + 1).astype(np.float32)


def shingles(tokens: list[str], idf: np.ndarray, known: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text (sorted hashes) and their TF-IDF weights, which float32 holds exactly; a shorter text is one shingle."""
    if not tokens:
        return np.zeros(0, np.uint64), np.zeros(0)
    own = hashes_of(tokens, known)
    rarity = idf[(own % np.uint64(BUCKETS)).astype(np.int64)].astype(np.float64)
    width = min(SHINGLE, len(own))
    n = len(own) - width + 1
    mixed, mean = np.zeros(n, np.uint64), np.zeros(n)
    for k in range(width):
        mixed = mixed * _SPREAD + own[k : k + n]
        mean += rarity[k : k + n]
    names, first, counts = np.unique(_mix(mixed), return_index=True, return_counts=True)
    return names, (counts * mean[first] / width).astype(np.float32).astype(np.float64)


class Sampler:
    """BANDS x ROWS consistent weighted samples of a bag; the variates come from tables by a hash of the shingle."""

    def __init__(self) -> None:
        draw = np.random.default_rng(7)
        size, k = 1 << 16, BANDS * ROWS
        self.rate = (-np.log(draw.random(size) * draw.random(size) + 1e-300)).astype(np.float32)
        self.inverse = (1 / self.rate).astype(np.float32)
        self.shift = draw.random(size).astype(np.float32)
        self.log_c = np.log(-np.log(draw.random(size) * draw.random(size) + 1e-300)).astype(np.float32)
        odd = draw.integers(1, 1 << 63, (2, k), dtype=np.uint64) | np.uint64(1)
        self.one, self.two = odd

    def bands(self, names: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """A 64-bit key of each band."""
        k = BANDS * ROWS
        least, found, steps = np.full(k, np.inf, np.float32), np.zeros(k, np.uint64), np.zeros(k, np.int64)
        for at in range(0, len(names), SLICE):
            name, log_w = names[at : at + SLICE], np.log(weights[at : at + SLICE]).astype(np.float32)
            a = ((name[:, None] * self.one) >> np.uint64(48)).view(np.int64)
            b = ((name[:, None] * self.two) >> np.uint64(48)).view(np.int64)
            shift = self.shift.take(a)
            step = self.inverse.take(a)
            step *= log_w[:, None]
            step += shift
            np.floor(step, out=step)
            value = step - shift
            value += 1
            value *= self.rate.take(a)
            np.subtract(self.log_c.take(b), value, out=value)
            best = value.argmin(axis=0)
            mine = value[best, np.arange(k)]
            lower = mine < least
            least[lower], found[lower] = mine[lower], name[best[lower]]
            steps[lower] = step[best, np.arange(k)][lower].astype(np.int64)
        sample = _mix(found + steps.astype(np.uint64) * _SPREAD).reshape(BANDS, ROWS)
        out = np.arange(BANDS, dtype=np.uint64)
        for r in range(ROWS):
            out = _mix(out * _SPREAD + sample[:, r])
        return out.astype(np.int64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum()
    either = a[1].sum() + b[1].sum() - shared
    return float(shared / either) if either > 0 else 0.0


def signatures(docs: DataFrame, idf, id_col: str, text_col: str) -> DataFrame:
    """A row for each document: row, doc, hi, lo (digest of its words), weight, keys (of the bands; none without words)."""

    @F.pandas_udf("hi long, lo long, weight double, keys array<long>")
    @tidied
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        sampler, known, rarity = Sampler(), Hashes(), idf.value
        for texts in batches:
            if len(known) > KNOWN:
                known.clear()
            hi, lo, weight, keys = [], [], [], []
            for text in texts:
                tokens = words(text or "")
                whole = " ".join(tokens) if tokens else "\0" + (text or "")
                digest = hashlib.blake2b(whole.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                hi.append(int.from_bytes(digest[:8], "big", signed=True))
                lo.append(int.from_bytes(digest[8:], "big", signed=True))
                names, own = shingles(tokens, rarity, known)
                weight.append(own.sum())
                keys.append(sampler.bands(names, own) if len(names) else np.zeros(0, np.int64))
            yield pd.DataFrame({"hi": hi, "lo": lo, "weight": weight, "keys": keys})

    # Ids stay on Spark's side: in pandas a null would turn the others into floats.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc"), sign(F.col(text_col)).alias("signed"))
    return rows.select("row", "doc", "signed.*")


def packed_bags(docs: DataFrame, rows: DataFrame, idf, text_col: str) -> DataFrame:
    """Shingles of the documents that `rows` numbers, packed once for all comparisons: row, names (uint64, sorted), weights (float32)."""

    @F.pandas_udf("names binary, weights binary")
    @tidied
    def pack(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known, rarity = Hashes(), idf.value
        for texts in batches:
            if len(known) > KNOWN:
                known.clear()
            bags = [shingles(words(text or ""), rarity, known) for text in texts]
            yield pd.DataFrame({"names": [n.tobytes() for n, _ in bags], "weights": [w.astype(np.float32).tobytes() for _, w in bags]})

    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text")).join(rows, "row")
    return texts.select("row", pack("text").alias("bag")).select("row", "bag.*")


def unpacked(names: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(names, np.uint64), np.frombuffer(weights, np.float32).astype(np.float64)


def own_weights(bags: DataFrame) -> DataFrame:
    """Weight of the shingles that a document shares with no other of `bags`: row, own (rows without any are left out).

    Shingles are told apart by 32 bits of their hash. Two that fall together count as shared, which
    makes the bound that rests on this wider, never wrong.
    """

    @tidied
    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bags_ = [unpacked(n, w) for n, w in zip(batch["names"], batch["weights"])]
            if bags_:
                yield pd.DataFrame(
                    {
                        "name": np.concatenate([n for n, _ in bags_]).astype(np.uint32).view(np.int32),
                        "row": np.repeat(batch["row"].to_numpy(), [len(n) for n, _ in bags_]),
                        "weight": np.concatenate([w for _, w in bags_]).astype(np.float32),
                    }
                )

    held = bags.mapInPandas(tokens, "name int, row long, weight float").groupBy("name").agg(F.count("*").alias("n"), F.min("row").alias("row"), F.min("weight").alias("weight"))
    return held.where("n = 1").groupBy("row").agg(F.sum(F.col("weight").cast("double")).alias("own"))


def may_reach(a: F.Column, own_a: F.Column, b: F.Column, own_b: F.Column, similarity: float) -> F.Column:
    """Whether two documents of weights a and b can be similar: they share no more than what neither has alone."""
    shared = F.least(a - own_a, b - own_b)
    return shared >= similarity * (a + b - shared) * (1 - 1e-6)


def verified(pairs: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity reaches `similarity`. Pairs of one a follow each other."""
    second = bags.select(F.col("row").alias("b"), F.col("names").alias("names_b"), F.col("weights").alias("weights_b"))
    first = bags.select(F.col("row").alias("a"), F.col("names").alias("names_a"), F.col("weights").alias("weights_a"))

    @tidied
    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, bag = None, None
        for batch in batches:
            keep = []
            for a, *packed in zip(batch["a"], batch["names_a"], batch["weights_a"], batch["names_b"], batch["weights_b"]):
                if a != before:
                    before, bag = a, unpacked(*packed[:2])
                keep.append(weighted_jaccard(bag, unpacked(*packed[2:])) >= similarity)
            yield batch.loc[np.array(keep, bool), ["a", "b"]]

    return pairs.join(second, "b").join(first, "a").mapInPandas(check, "a long, b long")


def hubs_of(members: DataFrame) -> DataFrame:
    """The cleanest member of each bucket of two or more, which has the least share of its own: band, key, hub, hub_weight, hub_own."""
    lead = F.min(F.struct((F.col("own") / F.col("weight")).alias("share"), "row", "weight", "own"))
    found = members.groupBy("band", "key").agg(lead.alias("lead"), F.count("*").alias("n")).where("n > 1")
    return found.select("band", "key", F.col("lead.row").alias("hub"), F.col("lead.weight").alias("hub_weight"), F.col("lead.own").alias("hub_own"), "n")


def possible(rows: pd.DataFrame, similarity: float) -> np.ndarray:
    """Pairs that a group of a bucket's members has to compare, as a matrix.

    They are in different components, can be similar by their bounds, and no earlier band has them
    together (they are compared there). Of two different blocks only pairs across are asked for.
    """
    row, weight, own, root, side = (rows[c].to_numpy() for c in ("row", "weight", "own", "root", "side"))
    keys, band = np.stack(rows["keys"].to_numpy()), int(rows["band"].iloc[0])
    side = side.astype(bool)
    mixed, alone = side.any() and not side.all(), rows["low"].iloc[0] == rows["high"].iloc[0]
    out = np.zeros((len(row), len(row)), bool)
    if not (mixed or alone):
        return out
    for at in range(0, len(row), STRIP):  # strip by strip, as the bounds of all pairs at once would be many times the result
        own_at = slice(at, at + STRIP)
        strip = (root[own_at, None] != root) & (row[own_at, None] < row)
        shared = np.minimum((weight - own)[own_at, None], weight - own)
        strip &= shared >= similarity * (weight[own_at, None] + weight - shared) * (1 - 1e-6)
        if mixed:
            strip &= side[own_at, None] != side
        for k in range(band):
            strip &= keys[own_at, k][:, None] != keys[:, k]
        out[own_at] = strip
    out |= out.T.copy()
    return out


def linked(possibly: np.ndarray, root: np.ndarray, bags: list, similarity: float) -> Iterator[tuple[int, int]]:
    """Of the possible pairs of members those that are similar; a pair that others link meanwhile isn't needed."""
    names, local = np.unique(np.concatenate([b[0] for b in bags]), return_inverse=True)
    cuts = np.r_[0, np.cumsum([len(b[0]) for b in bags])]
    weights, sums = np.concatenate([b[1] for b in bags]), np.array([b[1].sum() for b in bags])
    own, root, done = np.zeros(len(names)), root.copy(), np.zeros(len(bags), bool)
    for i in range(len(bags)):
        done[i] = True
        others = np.flatnonzero(possibly[i] & ~done & (root != root[i]))
        if not len(others):
            continue
        own[local[cuts[i] : cuts[i + 1]]] = weights[cuts[i] : cuts[i + 1]]
        for j in others.tolist():
            if root[j] == root[i]:
                continue
            at = slice(cuts[j], cuts[j + 1])
            shared = np.minimum(own[local[at]], weights[at]).sum()
            if shared >= (similarity - 1e-9) * (sums[i] + sums[j] - shared) and weighted_jaccard(bags[i], bags[j]) >= similarity:
                root[root == root[j]] = root[i]
                yield i, j
        own[local[cuts[i] : cuts[i + 1]]] = 0


def bucket_links(members: DataFrame, hubs: DataFrame, roots: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between members of a bucket that the pairs with its hub left apart.

    All pairs that may be similar are looked at, whatever the bucket's size, but no row is made for a
    pair. Members outside the hub's component are loose; they lie in blocks, and a block of loose
    members meets each other block, of loose members or of the hub's component, in one task. Members of
    one component need no further link; the hub has met all others already.
    """
    rows = members.join(hubs.where("n > 2").select("band", "key", "hub"), ["band", "key"])
    rows = rows.join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    core = roots.select(F.col("node").alias("hub"), F.col("root").alias("core"))
    rows = cut(rows.join(core, "hub", "left").withColumn("loose", F.col("root") != F.coalesce("core", "hub")).where("row <> hub").drop("hub", "core"))

    def blocks(of: F.Column) -> F.Column:
        n, weight = F.count(F.when(of, 1)), F.sum(F.when(of, F.col("weight")).otherwise(0.0))
        return F.ceil(F.greatest(n / MEMBERS, weight / WEIGHT)).cast("int")

    buckets = cut(rows.groupBy("band", "key").agg(blocks(F.col("loose")).alias("n_loose"), blocks(~F.col("loose")).alias("n_core")).where("n_loose > 0"))
    rows = rows.join(buckets, ["band", "key"])
    spot = F.xxhash64("row")
    block = F.when(F.col("loose"), F.pmod(spot, "n_loose")).otherwise(F.col("n_loose") + F.pmod(spot, F.greatest("n_core", F.lit(1)))).cast("int")
    last = F.when(F.col("loose"), F.col("n_loose") + F.col("n_core")).otherwise(F.col("n_loose")) - 1
    rows = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    group = ["band", "key", "low", "high"]
    fields = [*group, "side", "row", "weight", "own", "root", "keys"]
    met = rows.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other"), "side": F.col("block") > F.col("other")}).select(*fields)

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The rows of a group at a time; they follow each other."""
        held, before = [], None
        for batch in batches:
            if not len(batch):
                continue
            new = np.r_[True, (batch[group].to_numpy()[1:] != batch[group].to_numpy()[:-1]).any(axis=1)]
            starts = np.flatnonzero(new)
            for a, b in zip(starts, np.r_[starts[1:], len(batch)]):
                part, name = batch.iloc[a:b], tuple(batch[group].iloc[a])
                if held and name != before:
                    yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
                    held = []
                held.append(part)
                before = name
        if held:
            yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]

    @tidied
    def needed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in groups(batches):
            keep = possible(rows, similarity).any(axis=0)
            if keep.any():
                yield rows[keep]

    @tidied
    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in groups(batches):
            rows = rows.iloc[np.lexsort((rows["row"], rows["own"] / rows["weight"]))]  # the cleanest find most links
            bags = [unpacked(*x) for x in zip(rows["names"], rows["weights"])]
            names = rows["row"].to_numpy()
            found = [(names[i], names[j]) for i, j in linked(possible(rows, similarity), rows["root"].to_numpy(), bags, similarity)]
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])

    schema = ", ".join(f"{c} {kind}" for c, kind in met.dtypes)
    # Dealt out anew by the whole group, so that the block pairs of one bucket lie in many tasks.
    wanted = cut(met.repartition(*group).sortWithinPartitions(*group, "row").mapInPandas(needed, schema))
    return wanted.join(bags, "row").repartition(*group).sortWithinPartitions(*group, "row").mapInPandas(compared, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Class of every document: row, the id, class_id, class_size, first (the one document that stays).

    Documents of the same words are copies, whatever their case and punctuation; documents without a
    word (null counts as the empty text) are copies if their texts are equal. Others are linked if the
    weighted Jaccard similarity of their shingles reaches `similarity`, and classes are the connected
    components of links. class_id is the smallest id of the class (null where all are null); `first` is
    the row with that id, the earliest in the table among repeated ids. `row` numbers the rows of
    `docs`, which is read more than once and must come from files or a checkpoint. Other columns are
    not read, whatever their names. Texts of any length are taken whole: a long one has more shingles,
    which are sampled in slices. An empty table gives no row.
    """
    spark = docs.sparkSession
    small_batches(spark)
    idf = spark.sparkContext.broadcast(inverse_frequencies(*document_frequencies(docs, text_col)))
    signed = cut(signatures(docs, idf, id_col, text_col))
    # Tables that others join by a key are cut first: Spark splits a hot key only where both sides are plain shuffles.
    copies = cut(signed.groupBy("hi", "lo").agg(F.min("row").alias("rep")))
    members = signed.select("row", "doc", "hi", "lo").join(copies, ["hi", "lo"]).select("row", "doc", "rep")
    reps = signed.join(copies.select(F.col("rep").alias("row")), "row", "left_semi").select("row", "weight", "keys")
    reps = cut(reps)
    bands = reps.select("row", F.posexplode("keys").alias("band", "key"))

    shared = cut(bands.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    bands = cut(bands.join(shared, ["band", "key"]))
    bags = cut(packed_bags(docs, bands.select("row").distinct(), idf, text_col))
    # Whoever has too much alone is similar to nobody.
    able = reps.join(bags.select("row"), "row").join(own_weights(bags), "row", "left").withColumn("own", F.coalesce("own", F.lit(0.0)))
    able = cut(able.where(F.col("weight") - F.col("own") >= similarity * F.col("weight") * (1 - 1e-6)))
    bands = cut(bands.join(able.select("row", "weight", "own", "keys"), "row"))

    hubs = cut(hubs_of(bands))
    stars = bands.join(hubs, ["band", "key"]).where("row <> hub").where(may_reach(*map(F.col, ("weight", "own", "hub_weight", "hub_own")), similarity))
    stars = cut(stars.select(F.col("hub").alias("a"), F.col("row").alias("b")).distinct())
    roots = components(verified(stars, bags, similarity))
    more = bucket_links(bands, hubs, roots, bags, similarity)
    joined = more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
    roots = components(joined)

    classed = cut(members.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("row", "doc", F.coalesce("root", "rep").alias("root")))
    classes = cut(
        classed.groupBy("root").agg(
            F.min("doc").alias("class_id"),
            F.count("*").alias("class_size"),
            F.min(F.struct(F.col("doc").isNull(), "doc", "row")).alias("lead"),
        )
    )
    return classed.join(classes, "root").select(
        "row", F.col("doc").alias(id_col), "class_id", "class_size", (F.col("row") == F.col("lead.row")).alias("first")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of `docs` without all but the first of each class, columns as they are."""
    kept = cut(near_duplicates(docs, id_col, text_col, similarity).where("first").select("row"))
    whole = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc"))
    return whole.join(kept, "row", "left_semi").select("doc.*")


def op3_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("row")
