"""Hard negatives by bit-sliced integer products.

Rows are packed in blocks of bit-planes, one plane for each binary digit of the components. A block's
products with a set of anchors are summed plane by plane, the most significant first. What the planes
to come can still add lies between two bounds, so each score lies in an interval that narrows with
every plane; a row is dropped for an anchor as soon as its interval can't qualify any more.

Two passes: the first finds every anchor's positives among the rows of its label, the second its
negatives among the others, within the limits that the positives' scores set. In both, anchors are
packed in sets, sets stand in troops of a bounded size, and rows are dealt to lanes. Every troop meets
every lane that it asks for, so rows are copied once for each troop and not for each anchor.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, release, small_batches, table

#: The most rows of a block of bit-planes, anchors of a set, and sets of a troop; a task holds one block and one troop.
BLOCK_ROWS, SET_ANCHORS, TROOP_SETS = 2_048, 512, 32
#: Where vectors are long, blocks and troops hold fewer, so that neither takes more bytes than this.
HELD_BYTES = 1 << 24
#: The most rows of a lane; a troop meets a lane in one group.
LANE_ROWS = 262_144
#: Labels fall into so many buckets by their hash; a set of anchors is of one bucket and looks for positives in that one only.
LABEL_BUCKETS = 64
#: Share of open pairs below which products are taken pair by pair.
SPARSE = 1 / 24
#: Sums of products below this are exact in double precision, and below the larger one in a long.
EXACT, LONG = 1 << 53, 1 << 62
#: Stands for a null id, so that it comes after all others.
NO_ID = (1 << 63) - 1

ROWS = "bucket int, lane int, n int, keys binary, ids binary, labels binary, planes binary, bits int, dims int"


def usable(embeddings: DataFrame, id_col: str, vector_col: str, label: F.Column, scale: int = 256) -> DataFrame:
    """Rows that take part, in whole numbers: key, id, label, x.

    Rows with a null label, a null vector, or a null or non-finite component are left out. Each
    component becomes the floor of `scale` times itself, as a double. Every row has a key of its own, so
    repeated ids are rows of their own; a null id comes after all others among equal scores. The rows
    are cut off, as their keys must not change between readings.
    """
    fine = F.forall(vector_col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = embeddings.where(F.col(vector_col).isNotNull() & fine).select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), label.cast("long").alias("label"), F.transform(vector_col, lambda c: F.floor(scale * c.cast("double"))).alias("x")
    )
    return cut(rows.where("label IS NOT NULL").withColumn("key", F.monotonically_increasing_id()))


def lanes_of(rows: DataFrame) -> int:
    """Lanes for a table: no longer than LANE_ROWS, and enough of them for all cores as long as a lane fills a block."""
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    return max(1, math.ceil(n / LANE_ROWS), min(math.ceil(n / BLOCK_ROWS), 2 * cores))


def pack(rows: DataFrame, size: int, lanes: int, dims: int, bits: int) -> DataFrame:
    """Rows (key, id, label, x) in blocks of at most `size`, each of one bucket of labels (see ROWS).

    Components are stored in two's complement, a plane of bits for each digit, the sign's first. A
    shorter vector counts as one filled up with zeros.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        shifts = np.arange(bits - 1, -1, -1, dtype=np.int64)

        def block(bucket: int, lane: int, part: pd.DataFrame) -> tuple:
            x = np.zeros((len(part), dims), np.int64)
            for k, row in enumerate(part["x"]):
                x[k, : len(row)] = row
            planes = np.packbits((x[None] >> shifts[:, None, None]) & 1)
            plain = [part[c].to_numpy(np.int64).tobytes() for c in ("key", "id", "label")]
            return bucket, lane, len(part), *plain, planes.tobytes(), bits, dims

        for batch in batches:
            out = []
            for (bucket, lane), part in batch.groupby(["bucket", "lane"]):
                out += [block(bucket, lane, part.iloc[k : k + size]) for k in range(0, len(part), size)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ROWS.split(", ")])

    placed = rows.withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(LABEL_BUCKETS)).cast("int")).withColumn("lane", F.pmod(F.xxhash64("key"), F.lit(lanes)).cast("int"))
    # Equal buckets and lanes lie together, so blocks are full but for the last of each.
    return placed.repartition("bucket", "lane").sortWithinPartitions("bucket", "lane").mapInPandas(run, ROWS)


class Block:
    """A block's rows, unpacked."""

    def __init__(self, row):
        self.keys, self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("keys", "ids", "labels"))
        n, dims, bits = int(row["n"]), int(row["dims"]), int(row["bits"])
        self.bits = bits
        self.planes = np.unpackbits(np.frombuffer(row["planes"], np.uint8), count=bits * n * dims).reshape(bits, n, dims)

    def vectors(self) -> np.ndarray:
        """The components again, whole."""
        weights = 1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64)
        weights[0] = -weights[0]
        return np.tensordot(weights, self.planes.astype(np.int64), 1)


def tightened(block: Block, anchors: np.ndarray, open_pairs: np.ndarray, limits) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Pairs of a row and an anchor that can't be dropped, and their exact scores: row, anchor, score; and how many stayed open after each plane.

    open_pairs[r, a] says which pairs count at all. `limits(low, high, open)` is told the bounds of every
    score so far and says, for each anchor, which scores still qualify: the least and the largest.
    """
    n, dims = block.planes.shape[1:]
    bound = dims * int(np.abs(anchors).max(initial=0)) << block.bits
    if bound >= LONG:
        raise OverflowError("scores of these components don't fit a long")
    kind = np.float64 if bound < EXACT else np.int64  # either is exact here; doubles are faster
    own = anchors.astype(kind)
    up, down = np.maximum(anchors, 0).sum(axis=1).astype(kind), np.minimum(anchors, 0).sum(axis=1).astype(kind)
    rows, columns, scores, left = np.arange(n), None, np.zeros((n, len(anchors)), kind), []
    for k in range(block.bits):
        weight = (-1 if k == 0 else 1) << (block.bits - 1 - k)
        rest = (1 << (block.bits - 1 - k)) - 1  # the most that the planes to come can add to a component
        if columns is None:
            scores += weight * (block.planes[k][rows].astype(kind) @ own.T)
            low, high = scores + rest * down, scores + rest * up
            least, most = limits(low, high, open_pairs)
            open_pairs &= (high >= least) & (low <= most)
            left.append(int(open_pairs.sum()))
            if left[-1] < SPARSE * n * len(anchors):
                at, columns = np.nonzero(open_pairs)
                rows, scores = rows[at], scores[at, columns]
            else:
                kept = open_pairs.any(axis=1)
                if not kept.all():
                    rows, scores, open_pairs = rows[kept], scores[kept], open_pairs[kept]
        else:
            step = max(1, (1 << 20) // dims)  # bounds what is gathered at once
            for start in range(0, len(rows), step):
                some = slice(start, start + step)
                scores[some] += weight * (block.planes[k][rows[some]] * own[columns[some]]).sum(axis=1)
            kept = (scores + rest * up[columns] >= least[columns]) & (scores + rest * down[columns] <= most[columns])
            rows, columns, scores = rows[kept], columns[kept], scores[kept]
            left.append(len(rows))
    if columns is None:
        at, columns = np.nonzero(open_pairs)
        rows, scores = rows[at], scores[at, columns]
    return rows, columns, scores.astype(np.int64), left


class Best:
    """The best few of each list, by score and then the smaller id; added to piece by piece."""

    def __init__(self, size: int):
        self.size = size
        self.lists, self.scores, self.ids, self.keys = (np.zeros(0, np.int64) for _ in range(4))

    def add(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
        lists, scores, ids, keys = (np.concatenate(x) for x in zip((self.lists, self.scores, self.ids, self.keys), (lists, scores, ids, keys)))
        order = np.lexsort((keys, ids, -scores, lists))
        lists, scores, ids, keys = lists[order], scores[order], ids[order], keys[order]
        first = np.searchsorted(lists, lists)  # where each one's list begins
        kept = np.arange(len(lists)) - first < self.size
        self.lists, self.scores, self.ids, self.keys = lists[kept], scores[kept], ids[kept], keys[kept]

    def last_scores(self, n: int) -> np.ndarray:
        """For each of n lists the score that a newcomer must reach: the last one's of a full list, else the lowest there is."""
        out = np.full(n, -LONG, np.int64)
        ends = np.searchsorted(self.lists, np.arange(n), "right")
        full = ends - np.searchsorted(self.lists, np.arange(n)) == self.size
        out[full] = self.scores[ends[full] - 1]
        return out


def meet(blocks: DataFrame, lanes: int, sets: DataFrame, troop_sets: int, same_bucket: bool, run, schema: str) -> DataFrame:
    """Every troop of sets of anchors with the blocks of every lane (of its own bucket only, if wished), in groups of one troop and one lane.

    `run` makes an object of a set; blocks are added to it one by one and its result is a frame.
    """
    asks = F.col("bucket") if same_bucket else F.lit(0)
    counts = sets.groupBy(asks.alias("asks")).agg(F.ceil(F.count("*") / troop_sets).cast("int").alias("troops"))
    troops = F.create_map(*(F.lit(x) for row in counts.collect() for x in row), F.lit(-1), F.lit(0))  # a number for each bucket of labels at most
    number = F.coalesce(F.try_element_at(troops, F.col("asks")), F.lit(0))
    key = ["asks", "troop", "lane"]
    copies = blocks.withColumn("asks", asks).withColumn("troop", F.explode(F.when(number > 0, F.sequence(F.lit(0), number - 1)))).withColumn("kind", F.lit(1))
    placed = sets.withColumn("asks", asks).withColumn("troop", F.pmod(F.xxhash64("set"), number).cast("int")).drop("lane")
    askers = placed.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).withColumn("kind", F.lit(0))

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        troop, at = [], None
        for batch in batches:
            for row in batch.to_dict("records"):
                now = row["asks"], row["troop"], row["lane"]
                if now != at:
                    yield from (member.result() for member in troop)
                    troop, at = [], now
                if row["kind"] == 0:
                    troop.append(run(row))
                elif troop:
                    block = Block(row)
                    for member in troop:
                        member.add(block)
        yield from (member.result() for member in troop)

    both = askers.unionByName(copies, allowMissingColumns=True)
    return both.repartition(*key).sortWithinPartitions(*key, "kind").mapInPandas(groups, schema)


FOUND = "set long, place int, list int, id long, key long, score long"


class Positives:
    """A set's best rows of the same label, in one lane."""

    def __init__(self, row, size: int):
        self.set, self.own, self.best = row["set"], Block(row), Best(size)
        self.x, self.size = self.own.vectors(), size

    def add(self, block: Block) -> None:
        n = len(self.x)
        same = (block.labels[:, None] == self.own.labels) & (block.keys[:, None] != self.own.keys)
        if not same.any():
            return
        need = self.best.last_scores(n)

        def limits(low, high, open_pairs):
            # Where enough rows of this block surely reach a score, others must reach it too.
            if len(low) >= self.size:
                sure = np.partition(np.where(open_pairs, low, -LONG), len(low) - self.size, axis=0)[len(low) - self.size]
                np.maximum(need, sure.astype(np.int64), out=need)
            return need, np.full(n, LONG)

        rows, columns, scores, _ = tightened(block, self.x, same, limits)
        self.best.add(columns, scores, block.ids[rows], block.keys[rows])

    def result(self) -> pd.DataFrame:
        b = self.best
        return pd.DataFrame({"set": np.int64(self.set), "place": b.lists.astype(np.int32), "list": np.int32(0), "id": b.ids, "key": b.keys, "score": b.scores})


class Negatives:
    """A set's best rows of other labels within the limits of each positive, in one lane."""

    def __init__(self, row, size: int, least_share: int):
        self.set, self.own, self.best = row["set"], Block(row), Best(size)
        self.x = self.own.vectors()
        places, scores = np.asarray(row["places"], np.int64), np.asarray(row["limits"], np.int64)
        self.places, self.most = places, scores
        hundreds, rest = np.divmod(scores, 100)  # apart, as a hundred times a score may not fit a long
        self.least = least_share * hundreds - (-least_share * rest) // 100  # the smallest whole score that is large enough
        self.of = [np.nonzero(places == k)[0] for k in range(len(self.x))]

    def add(self, block: Block) -> None:
        n = len(self.x)
        need = np.maximum(self.least, self.best.last_scores(len(self.places)))
        low_of, high_of = np.full(n, LONG), np.full(n, -LONG)
        np.minimum.at(low_of, self.places, np.where(need <= self.most, need, LONG))
        np.maximum.at(high_of, self.places, self.most)
        other = (block.labels[:, None] != self.own.labels) & (low_of < LONG)
        if not other.any():
            return
        rows, columns, scores, _ = tightened(block, self.x, other, lambda low, high, open_pairs: (low_of, high_of))
        for k in range(max((len(x) for x in self.of), default=0)):  # the k-th positive of every anchor
            listed = np.array([x[k] if k < len(x) else -1 for x in self.of], np.int64)[columns]
            inside = (listed >= 0) & (scores >= self.least[listed]) & (scores <= self.most[listed])
            self.best.add(listed[inside], scores[inside], block.ids[rows[inside]], block.keys[rows[inside]])

    def result(self) -> pd.DataFrame:
        b = self.best
        return pd.DataFrame({"set": np.int64(self.set), "place": self.places[b.lists].astype(np.int32), "list": b.lists.astype(np.int32), "id": b.ids, "key": b.keys, "score": b.scores})


def first_of(found: DataFrame, size: int) -> DataFrame:
    """The best few of each list over all lanes, with `rank` from 1; a lane gives no more than that many of a list."""
    order = Window.partitionBy("set", "place", "list").orderBy(F.desc("score"), "id", "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def mine(rows: DataFrame, is_anchor: F.Column, positives: int = 5, negatives: int = 5, least_share: int = 80) -> DataFrame:
    """Hard negatives of every anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `rows` has key, id, label, x (see `usable`); `is_anchor` selects anchors by id. A row's score is its
    inner product with the anchor. Positives are the first other rows of the anchor's label, negatives
    the first rows of other labels whose score is at most the positive's and at least `least_share`
    hundredths of it; higher scores come first, ties by the smaller id. A positive without negatives
    gives no row, a negative score of a positive neither. A repeated anchor row is mined for each time,
    and its copies are other rows. A table without anchors, or with one label, gives no row. Scores that
    don't fit a long are an error.
    """
    dims, low, high = rows.agg(F.max(F.size("x")), F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    dims, bits = max(dims or 0, 1), max(int(low or 0).bit_length(), int(high or 0).bit_length()) + 1
    small_batches(rows.sparkSession, 8)
    lanes, anchors = lanes_of(rows), rows.where(is_anchor)
    troop_sets = max(1, min(TROOP_SETS, HELD_BYTES // (8 * dims * SET_ANCHORS)))
    blocks = cut(pack(rows, max(16, min(BLOCK_ROWS, HELD_BYTES // (dims * bits))), lanes, dims, bits))
    sets = cut(pack(anchors, SET_ANCHORS, math.ceil((anchors.count() + 1) / (SET_ANCHORS * TROOP_SETS)), dims, bits).withColumn("set", F.monotonically_increasing_id()))

    near = first_of(meet(blocks, lanes, sets, troop_sets, True, lambda row: Positives(row, positives), FOUND), positives)
    near = cut(near.withColumn("list", F.row_number().over(Window.partitionBy("set").orderBy("place", "rank")) - 1))
    limits = near.groupBy("set").agg(F.array_sort(F.collect_list(F.struct("list", "place", "score"))).alias("found"))  # a few for each anchor of a set
    asked = sets.join(limits, "set").withColumn("places", F.transform("found", lambda f: f["place"])).withColumn("limits", F.transform("found", lambda f: f["score"])).drop("found")
    far = first_of(meet(blocks, lanes, asked, troop_sets, False, lambda row: Negatives(row, negatives, least_share), FOUND), negatives)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, ids in zip(batch["set"], batch["ids"]):
                found = np.frombuffer(ids, np.int64)
                yield pd.DataFrame({"set": np.int64(number), "place": np.arange(len(found), dtype=np.int32), "anchor_id": found})

    names = sets.select("set", "ids").mapInPandas(unpack, "set long, place int, anchor_id long")
    shown = near.join(names, ["set", "place"]).select("set", "list", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = far.select("set", "list", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(shown, ["set", "list"])
    named = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c)
    return out.select(named("anchor_id"), named("positive_id"), F.col("rank").cast("int").alias("rank"), named("negative_id"), "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(usable(rows, "vec_id", "embedding", label), (F.col("id") % 100 == 0) & (F.col("id") != NO_ID))


#: The same rows in DuckDB: every anchor's products with all rows.
ORACLE_SQL = """
    WITH e AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
        FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    s AS (
        SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.x, r.x)::BIGINT AS score
        FROM e a, e r WHERE a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
    p AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
        vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
    QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
"""
