"""Approximate nearest neighbours by cosine: an NN-descent graph and greedy search on it.

Rows with one and the same vector are one node. Nodes are laid out by their nearest anchor, so that a
block of them holds most of its nodes' neighbours, and a node's number tells its block. The graph
begins with the exact neighbours inside blocks, of this layout and of others with other anchors.

A round of NN-descent is two joins by block. Edges meet the nodes they lead to, from which each node
knows its neighbours in both directions; there, neighbours of neighbours are compared, if either is
new in the other's list. Better edges meet the blocks of the nodes they improve. A block keeps the
vectors its edges lead to, so a vector travels once to a block with the edge that first needs it.

A query walks the graph from its own node. It is sent to the blocks of the nodes it has yet to look
at; each searches greedily as far as its own nodes lead, and sends back the best and where they lead.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches, table

#: Neighbours of a node in the graph, and of those that another layout adds at the start.
NEIGHBOURS, ADDED = 24, 12
#: Descent has converged once a round improves less than this share of the edges.
LEAST_CHANGE = 0.001
#: Nodes of a block on average; layouts besides the nodes' own.
BLOCK, LAYOUTS = 4_096, 2
#: Most anchors, and those that a node is compared with first; with more of them it meets those nearest to one of these.
ANCHORS, FIRST = 1 << 16, 256
#: Candidates that a query keeps, all of which it opens.
BEAM = 128
#: Bits of a node's number within its block.
LOCAL = 20

STATE = "block int, data binary, fresh long, edges long"
MESSAGE = "block int, data binary"


def unit_nodes(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, full: float64 original as bytes) and their rows (row, id, node); `row` numbers the table's rows.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with a null id.
    """

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row, key, value in zip(batch["row"], batch["id"], batch["vector"]):
                try:
                    full = np.asarray(value, dtype=np.float64)
                except (TypeError, ValueError):
                    continue
                if len(full) and np.isfinite(full).all() and np.abs(full).max() > 0:
                    rows.append((row, key, (full + 0.0).tobytes()))
            yield pd.DataFrame(rows, columns=["row", "id", "full"])

    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    rows = cut(rows.where("id IS NOT NULL AND vector IS NOT NULL").mapInPandas(packed, "row long, id long, full binary"))
    nodes = cut(rows.groupBy("full").agg(F.min("row").alias("node")))
    return nodes, cut(rows.join(nodes, "full").select("row", "id", "node"))


def units(packed: list[bytes]) -> np.ndarray:
    """Unit vectors as float32 rows, of originals of one length packed as float64."""
    full = np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), -1)
    full = full / np.abs(full).max(axis=1, keepdims=True)
    return (full / np.linalg.norm(full, axis=1, keepdims=True)).astype(np.float32)


def best(owner: np.ndarray, other: np.ndarray, sim: np.ndarray, k: int) -> np.ndarray:
    """Where the k most similar distinct others of each owner stand, ordered by owner and similarity."""
    order = np.lexsort((other, -sim, owner))
    a, b = owner[order], other[order]
    pair = np.lexsort((np.arange(len(a)), b, a))
    again = np.zeros(len(a), bool)
    again[pair[1:]] = (a[pair[1:]] == a[pair[:-1]]) & (b[pair[1:]] == b[pair[:-1]])
    order, a = order[~again], a[~again]
    at = np.arange(len(a))
    first = np.r_[True, a[1:] != a[:-1]] if len(a) else np.zeros(0, bool)
    return order[at - np.maximum.accumulate(np.where(first, at, 0)) < k] if len(a) else order


def lists(owner: np.ndarray, n: int, k: int, *columns: tuple[np.ndarray, object]) -> list[np.ndarray]:
    """Columns of edges, ordered by owner (0 to n - 1, at most k each), as n x k matrices with a filler."""
    first = np.searchsorted(owner, np.arange(n))
    at = np.arange(len(owner)) - first[owner]
    out = []
    for values, filler in columns:
        matrix = np.full((n, k), filler, values.dtype)
        matrix[owner, at] = values
        out.append(matrix)
    return out


def layout(nodes: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Blocks of nodes that lie together: block, the key, full.

    Anchors are nodes by a hash; at most ANCHORS of them are fetched. Where many nodes share their
    nearest anchor, a hash of the key parts them into blocks. Vectors of different lengths share no block.
    """
    spark = nodes.sparkSession
    sample = nodes.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(max(1, min(ANCHORS, n // BLOCK))).select("full").toPandas()["full"].tolist()
    anchors: dict[int, tuple] = {}
    for size in {len(x) for x in sample}:
        own = units([x for x in sample if len(x) == size])
        first = own[:FIRST]
        anchors[size] = (own, first, (own @ first.T).argmax(axis=1) if len(own) > FIRST else None)
    sent = spark.sparkContext.broadcast(anchors)

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["full"].map(len).to_numpy()
            cell = np.zeros(len(batch), np.int64)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                if size in sent.value:
                    own, first, group = sent.value[size]
                    unit = units(batch["full"].iloc[at].tolist())
                    near = (unit @ first.T).argmax(axis=1)
                    if group is not None:
                        for g in np.unique(near):
                            mine, inside = np.flatnonzero(near == g), np.flatnonzero(group == g)
                            near[mine] = inside[(unit[mine] @ own[inside].T).argmax(axis=1)]
                    cell[at] = near
                cell[at] += size << 20
            yield batch.assign(cell=cell)

    placed = cut(nodes.select(key, "full").mapInPandas(cells, f"{key} long, full binary, cell long"))
    counts = placed.groupBy("cell").count().orderBy("cell").toPandas()  # a row for each anchor, and for each length of vectors
    counts["parts"] = np.maximum(1, np.ceil(counts["count"] / (2 * BLOCK))).astype(int)
    counts["begin"] = counts["parts"].cumsum() - counts["parts"]
    if not len(counts):
        return placed.select(F.lit(0).alias("block"), key, "full")
    bounds = spark.createDataFrame(counts[["cell", "parts", "begin"]], "cell long, parts int, begin int")
    block = (F.col("begin") + F.pmod(F.xxhash64(key, F.lit(seed)), "parts")).cast("int")
    return placed.join(F.broadcast(bounds), "cell").select(block.alias("block"), key, "full")


def block_neighbours(batch: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of a block's nodes in order, unit vectors, and each one's k nearest inside: places and similarities."""
    batch = batch.sort_values("nid")
    unit, n = units(batch["full"].tolist()), len(batch)
    top = min(k, n - 1)
    places, sims = np.full((n, k), -1), np.full((n, k), -2, np.float32)
    for a in range(0, n if top > 0 else 0, 512):
        near = unit[a : a + 512] @ unit.T
        near[np.arange(len(near)), np.arange(a, a + len(near))] = -2
        at = np.argpartition(-near, top - 1, axis=1)[:, :top]
        at = np.take_along_axis(at, np.argsort(-np.take_along_axis(near, at, 1), axis=1, kind="stable"), 1)
        places[a : a + 512, :top], sims[a : a + 512, :top] = at, np.take_along_axis(near, at, 1)
    return batch["nid"].to_numpy(np.int64), unit, places, sims


def begun(batch: pd.DataFrame) -> pd.DataFrame:
    """A block's part of the graph: its nodes' numbers and vectors, others and their similarities (-1 and -2 where
    there are fewer), which of them are new, and the vectors outside that these lead to, with their worst similarity."""
    nid, unit, places, sims = block_neighbours(batch, NEIGHBOURS)
    others = np.where(places < 0, -1, nid[places])
    own = {"nid": nid, "unit": unit, "others": others, "sims": sims, "new": others >= 0}
    own |= {"names": np.zeros(0, np.int64), "vectors": np.zeros((0, unit.shape[1]), np.float16), "worst": np.zeros(0, np.float32)}
    return pd.DataFrame({"block": [int(nid[0] >> LOCAL)], "data": [pickle.dumps(own)], "fresh": [0], "edges": [0]})


def messages(owner: np.ndarray, other: np.ndarray, sim: np.ndarray, new: np.ndarray, names: np.ndarray, vectors: np.ndarray, worst: np.ndarray) -> pd.DataFrame:
    """Edges of owners to others for the owners' blocks, with the vectors of others from outside those; `names` is sorted."""
    order = np.argsort(owner, kind="stable")
    owner, other, sim, new = owner[order], other[order], sim[order], new[order]
    to = owner >> LOCAL
    cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else []
    rows = []
    for a, b in zip(cuts, np.r_[cuts[1:], len(to)]):
        outside = np.unique(other[a:b][other[a:b] >> LOCAL != to[a]])
        at = np.searchsorted(names, outside)
        data = {"owner": owner[a:b], "other": other[a:b], "sim": sim[a:b], "new": new[a:b], "names": outside, "vectors": vectors[at].astype(np.float16), "worst": worst[at]}
        rows.append((int(to[a]), pickle.dumps(data)))
    return pd.DataFrame(rows, columns=["block", "data"])


def added(batch: pd.DataFrame) -> pd.DataFrame:
    """Edges inside a block of another layout, for the blocks of the nodes' own layout."""
    nid, unit, places, sims = block_neighbours(batch, ADDED)
    i, j = np.nonzero(places >= 0)
    return messages(nid[i], nid[places[i, j]], sims[i, j], np.ones(len(i), bool), nid, unit, sims[:, -1])


def known(own: dict, came: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All vectors that a block has or is sent: names in order, vectors, worst similarities."""
    parts = [(own["nid"], own["unit"], own["sims"][:, -1]), *((x["names"], x["vectors"], x["worst"]) for x in (own, *came))]
    names, at = np.unique(np.concatenate([x[0] for x in parts]), return_index=True)
    return names, np.concatenate([x[1] for x in parts])[at].astype(np.float32), np.concatenate([x[2] for x in parts])[at]


def joined(came: list[dict], field: str, kind: type) -> np.ndarray:
    return np.concatenate([x[field] for x in came]) if came else np.zeros(0, kind)


def read(frame: pd.DataFrame) -> list[dict]:
    return [pickle.loads(x) for x in frame["data"]]


def improved(frame: pd.DataFrame, came: pd.DataFrame) -> pd.DataFrame:
    """A block's part of the graph with better edges taken in; how many are fresh, of how many."""
    if not len(frame):
        return pd.DataFrame(columns=["block", "data", "fresh", "edges"])
    (own,), came = read(frame), read(came)
    n, k = own["others"].shape
    names, vectors, worst = known(own, came)
    i, j = np.nonzero(own["others"] >= 0)
    more, leads, sim = np.searchsorted(own["nid"], joined(came, "owner", np.int64)), joined(came, "other", np.int64), joined(came, "sim", np.float32)
    better = ~(own["others"][more] == leads[:, None]).any(axis=1)
    more, leads, sim = more[better], leads[better], sim[better]
    first = not frame["edges"].iloc[0]  # before the first round all edges are new
    owner, other, sim = np.r_[i, more], np.r_[own["others"][i, j], leads], np.r_[own["sims"][i, j], sim]
    new = np.r_[np.full(len(i), first), np.ones(len(more), bool)]
    at = best(owner, other, sim, k)
    owner, other, sim, new = owner[at], other[at], sim[at], new[at]
    own["others"], own["sims"], own["new"] = lists(owner, n, k, (other, -1), (sim.astype(np.float32), -2), (new, False))
    outside = np.unique(other[other >> LOCAL != own["nid"][0] >> LOCAL])
    at = np.searchsorted(names, outside)
    own |= {"names": outside, "vectors": vectors[at].astype(np.float16), "worst": worst[at]}
    return pd.DataFrame({"block": frame["block"], "data": [pickle.dumps(own)], "fresh": [int(new.sum())], "edges": [len(new)]})


def turned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges the other way round, for the blocks of the nodes they lead to; a task sends a node its best NEIGHBOURS only."""
    owner, other, sim, new, names, vectors, worst = ([] for _ in range(7))
    for batch in batches:
        for own in read(batch):
            i, j = np.nonzero((own["others"] >= 0) & (own["others"] >> LOCAL != own["nid"][0] >> LOCAL))
            owner.append(own["others"][i, j])
            other.append(own["nid"][i])
            sim.append(own["sims"][i, j])
            new.append(own["new"][i, j])
            used = np.unique(i)
            names.append(own["nid"][used])
            vectors.append(own["unit"][used])
            worst.append(own["sims"][used, -1])
    if not owner:
        return
    for size in {v.shape[1] for v in vectors}:
        mine = [k for k, v in enumerate(vectors) if v.shape[1] == size]
        pick = lambda parts: np.concatenate([parts[k] for k in mine])  # noqa: B023, E731
        at = best(pick(owner), pick(other), pick(sim), NEIGHBOURS)
        order = np.argsort(pick(names))
        yield messages(pick(owner)[at], pick(other)[at], pick(sim)[at], pick(new)[at], pick(names)[order], pick(vectors)[order], pick(worst)[order])


def around(own: dict, came: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours of a block's nodes in both directions (n x 2 NEIGHBOURS numbers, -1 where there are fewer), and which are new."""
    n, k = own["others"].shape
    i, j = np.nonzero(own["others"] >= 0)
    inside = own["others"][i, j] >> LOCAL == own["nid"][0] >> LOCAL
    owner = np.r_[np.searchsorted(own["nid"], own["others"][i, j][inside]), np.searchsorted(own["nid"], joined(came, "owner", np.int64))]
    other = np.r_[own["nid"][i[inside]], joined(came, "other", np.int64)]
    sim, new = np.r_[own["sims"][i, j][inside], joined(came, "sim", np.float32)], np.r_[own["new"][i, j][inside], joined(came, "new", bool)]
    at = best(owner, other, sim, k)
    back, back_new = lists(owner[at], n, k, (other[at], -1), (new[at], False))
    both, flags = np.c_[own["others"], back], np.c_[own["new"], back_new]
    order = np.argsort(both, axis=1, kind="stable")
    ranked = np.take_along_axis(both, order, 1)
    again = np.zeros_like(flags)
    np.put_along_axis(again, order[:, 1:], ranked[:, 1:] == ranked[:, :-1], 1)
    both[again] = -1
    return both, flags & (both >= 0)


def compared(frame: pd.DataFrame, came: pd.DataFrame) -> pd.DataFrame:
    """Better edges among the neighbours of each node of a block; of two old neighbours all is known."""
    if not len(frame):
        return pd.DataFrame(columns=["block", "data"])
    (own,), came = read(frame), read(came)
    names, vectors, worst = known(own, came)
    both, new = around(own, came)
    owner, other, sim = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    for a in range(0, len(both), 256):
        part, fresh = both[a : a + 256], new[a : a + 256]
        at = np.searchsorted(names, np.where(part < 0, names[0], part))
        sims = np.matmul(vectors[at], vectors[at].transpose(0, 2, 1))
        better = sims > worst[at][:, :, None]
        better &= (fresh[:, :, None] | fresh[:, None, :]) & (part >= 0)[:, :, None] & (part >= 0)[:, None, :] & (part[:, :, None] != part[:, None, :])
        r, i, j = np.nonzero(better)
        owner, other, sim = np.r_[owner, part[r, i]], np.r_[other, part[r, j]], np.r_[sim, sims[r, i, j]]
        keep = best(owner, other, sim, NEIGHBOURS)
        owner, other, sim = owner[keep], other[keep], sim[keep]
    return messages(owner, other, sim, np.ones(len(owner), bool), names, vectors, worst)


def build_graph(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph by blocks (block, data), and the numbers of nodes in it (nid, node).

    Rounds go on until they hardly improve an edge; as edges only ever get better, that comes.
    Vectors that blocks send each other have half precision; the search uses single precision.
    """
    n = nodes.count()
    place = F.row_number().over(Window.partitionBy("block").orderBy("node")) - 1
    numbered = layout(nodes, "node", n, 0).withColumn("nid", F.shiftleft(F.col("block").cast("long"), LOCAL) + place)
    numbered = cut(numbered.select("nid", "node", "full"))
    graph = numbered.withColumn("block", F.shiftright("nid", LOCAL).cast("int")).groupBy("block").applyInPandas(begun, STATE)
    more = None
    for seed in range(1, LAYOUTS + 1):
        found = layout(numbered, "nid", n, seed).groupBy("block").applyInPandas(added, MESSAGE)
        more = found if more is None else more.unionByName(found)
    by_block = lambda a, b, f, schema: a.groupBy("block").cogroup(b.groupBy("block")).applyInPandas(f, schema)
    graph = cut(by_block(graph, more, improved, STATE))
    while True:
        edges = by_block(graph, graph.mapInPandas(turned, MESSAGE), compared, MESSAGE)
        graph = cut(by_block(graph, edges, improved, STATE))
        fresh, total = graph.agg(F.sum("fresh"), F.sum("edges")).first()
        if not total or fresh <= LEAST_CHANGE * total:
            break
    both = by_block(graph, graph.mapInPandas(turned, MESSAGE), _both_ways, MESSAGE)
    return cut(both), numbered.select("nid", "node")


def _both_ways(frame: pd.DataFrame, came: pd.DataFrame) -> pd.DataFrame:
    """What a search needs of a block: its nodes' vectors, and their neighbours in both directions."""
    if not len(frame):
        return pd.DataFrame(columns=["block", "data"])
    (own,), came = read(frame), read(came)
    data = {"nid": own["nid"], "unit": own["unit"], "near": around(own, came)[0]}
    return pd.DataFrame({"block": frame["block"], "data": [pickle.dumps(data)]})


QUERY = "home int, query long, vec binary, found binary, sims binary, ahead binary"
QUERY_COLUMNS = ["home", "query", "vec", "found", "sims", "ahead"]


def walked(part: pd.DataFrame, asked: pd.DataFrame, beam: int) -> pd.DataFrame:
    """Greedy search of queries inside one block, from the nodes they ask for as far as its own nodes lead.

    All that comes among a query's `beam` best is opened; `ahead` are the nodes of other blocks that it leads to.
    """
    if not len(part) or not len(asked):
        return pd.DataFrame(columns=QUERY_COLUMNS)
    (own,) = read(part)
    nid, block, out = own["nid"], own["nid"][0] >> LOCAL, []
    for home, query, vec, start, found, sims in zip(*(asked[c] for c in ("home", "query", "vec", "start", "found", "sims"))):
        asking, start = np.frombuffer(vec, np.float32), np.frombuffer(start, np.int64)
        found, sims = np.frombuffer(found, np.int64), np.frombuffer(sims, np.float32)
        before, ahead, done = found, [np.zeros(0, np.int64)], np.zeros(0, np.int64)
        while len(start):
            done = np.union1d(done, start)
            found, sims = np.r_[found, start], np.r_[sims, own["unit"][np.searchsorted(nid, start)] @ asking]
            keep = np.argsort(-sims, kind="stable")[:beam]
            found, sims = found[keep], sims[keep]
            near = own["near"][np.searchsorted(nid, np.intersect1d(found, start))]
            near = np.unique(near[near >= 0])
            inside = near >> LOCAL == block
            ahead.append(near[~inside])
            start = np.setdiff1d(near[inside], np.r_[done, before])
        mine = np.isin(found, before, invert=True)
        out.append((home, query, None, found[mine].tobytes(), sims[mine].astype(np.float32).tobytes(), np.unique(np.concatenate(ahead)).tobytes()))
    return pd.DataFrame(out, columns=QUERY_COLUMNS)


def gathered(rows: pd.DataFrame, beam: int) -> pd.DataFrame:
    """Queries with what all blocks have found for them: the `beam` best, and the nodes to look at next."""
    out = []
    for query, own in rows.groupby("query"):
        found, sims = np.frombuffer(b"".join(own["found"]), np.int64), np.frombuffer(b"".join(own["sims"]), np.float32)
        found, at = np.unique(found, return_index=True)
        keep = np.argsort(-sims[at], kind="stable")[:beam]
        came = own["vec"].isna()
        ahead = np.setdiff1d(np.frombuffer(b"".join(own["ahead"][came]), np.int64), found)
        out.append((rows["home"].iloc[0], query, own["vec"][~came].iloc[0], found[keep].tobytes(), sims[at][keep].tobytes(), ahead.tobytes()))
    return pd.DataFrame(out, columns=QUERY_COLUMNS)


def requests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each block that holds nodes which a query has yet to look at."""
    for batch in batches:
        rows = []
        for home, query, vec, found, sims, ahead in zip(*(batch[c] for c in QUERY_COLUMNS)):
            ahead = np.frombuffer(ahead, np.int64)
            cuts = np.flatnonzero(np.diff(ahead >> LOCAL, prepend=-1))  # in order, so a block's nodes stand together
            rows += [(int(ahead[a] >> LOCAL), home, query, vec, ahead[a:b].tobytes(), found, sims) for a, b in zip(cuts, np.r_[cuts[1:], len(ahead)])]
        yield pd.DataFrame(rows, columns=["block", "home", "query", "vec", "start", "found", "sims"])


def search(queries: DataFrame, graph: DataFrame, top: int, beam: int = BEAM) -> DataFrame:
    """Greedy graph search for each query (query, nid: its own node, full): the `top` best nodes found (query, nid).

    A query opens what comes among its `beam` best, and is done when these lead to nothing better, so
    the nodes it opens do not grow with the table.
    """
    beam = max(beam, 2 * top)

    def walk(part: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        return walked(part, asked, beam)

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        return gathered(rows, beam)

    def started(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            nid = batch["nid"].to_numpy(np.int64)
            vectors = [units([x])[0].tobytes() for x in batch["full"]]
            none = [b""] * len(nid)
            yield pd.DataFrame({"home": (nid >> LOCAL).astype(np.int32), "query": batch["query"], "vec": vectors, "found": none, "sims": none, "ahead": [x.tobytes() for x in nid]})

    def finished(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.frombuffer(x, np.int64)[:top] for x in batch["found"]]
            yield pd.DataFrame({"query": np.repeat(batch["query"].to_numpy(np.int64), [len(x) for x in found]), "nid": np.concatenate([np.zeros(0, np.int64), *found])})

    asked = "block int, home int, query long, vec binary, start binary, found binary, sims binary"
    state = cut(queries.mapInPandas(started, QUERY))
    while state.where(F.octet_length("ahead") > 0).limit(1).count():
        asking = state.mapInPandas(requests, asked)
        met = graph.groupBy("block").cogroup(asking.groupBy("block")).applyInPandas(walk, QUERY)
        state = cut(state.unionByName(met).groupBy("home").applyInPandas(gather, QUERY))
    return state.mapInPandas(finished, "query long, nid long")


def nearest(vectors: DataFrame, is_query: F.Column, top: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The `top` nearest rows found for each row that `is_query` selects: query_id, rank, vec_id, score.

    The score is the cosine of the original vectors in double precision; ties go to the smaller id.
    Every row but the query's own is a candidate, also one that repeats its id or its vector; copies of
    a vector are one node of the graph and come back as rows of their own. Fewer candidates than `top`
    give all of them. Rows whose vector is null, zero or not finite, or whose id is null, take no
    part; vectors of different lengths are never neighbours. Other columns are not read. An empty
    table gives no row. `vectors` is read twice and must come from files or a checkpoint.
    """
    small_batches(vectors.sparkSession)
    nodes, members = unit_nodes(vectors, id_col, vector_col)
    asking = vectors.select(F.monotonically_increasing_id().alias("query"), is_query.alias("asks")).where("asks").select("query")
    graph, numbers = build_graph(nodes)
    asking = members.withColumnRenamed("row", "query").join(asking, "query").join(numbers, "node").join(nodes, "node")
    asking = cut(asking.select("query", F.col("id").alias("query_id"), "nid", "full"))
    found = search(asking, graph, top=4 * (top + 1)).join(numbers, "nid")
    # Of a node's copies the smallest ids are enough: they come first among equals.
    few = members.select("node", "id", "row", F.row_number().over(Window.partitionBy("node").orderBy("id", "row")).alias("n")).where(F.col("n") <= top + 1)
    pairs = found.select("query", "node").join(asking.drop("nid"), "query").join(nodes.select("node", F.col("full").alias("other")), "node")

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores = []
            for full, other in zip(batch["full"], batch["other"]):
                a, b = np.frombuffer(full, np.float64), np.frombuffer(other, np.float64)
                # Squares of very large or small numbers would leave the range; powers of two change no digit.
                a, b = (np.ldexp(x, -np.frexp(np.abs(x).max())[1]) for x in (a, b))
                scores.append((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))
            yield batch[["query", "query_id", "node"]].assign(score=np.array(scores, float))

    scored = pairs.mapInPandas(exact, "query long, query_id long, node long, score double").join(few.select("node", "id", "row"), "node").where("row <> query")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id", "row")))
    return ranked.where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def op2_nn_descent(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
