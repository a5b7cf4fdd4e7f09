"""Every registered query over a small folder of tables with odd rows, and over empty tables, against brute force where its contract fixes the result."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import zlib

import corpus_pipeline
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from xxhash import xxh3_128_digest

from crosslight.llm import minhash, neighbours, substrings, tiff
from crosslight.llm.common import words
from crosslight.llm.graphs import components
from crosslight.llm.queries import QUERIES
from tests.compare import DATA

BIG = (1 << 62) + 1  # a float would not hold it
ODD = [(None, "a null id"), (BIG, None), (BIG + 2, ""), (None, None), (7, " \n"), (8, "same"), (8, "same"), (8, "another text of one id"), (9, "ÄÖ ΣΑΣ 한글 ́ ½"), (10, "word " * 20_000), (11, "字" * 3_000), (12, "<|endoftext|>it's")]


def tables(folder, docs, labels, vectors):
    text = [t for _, t in docs]
    columns = {"doc_id": pa.array([i for i, _ in docs], pa.int64()), "text": pa.array(text, pa.string()), "lang": pa.array([("en", "de", None)[k % 3] for k in range(len(docs))], pa.string())}
    columns |= {"source": pa.array(["s"] * len(docs), pa.string()), "n_chars": pa.array([len(t or "") for t in text], pa.int64())}
    columns |= {c: pa.array(["clash"] * len(docs), pa.string()) for c in ("_row", "row", "score", "rate", "band", "_id")}
    pq.write_table(pa.table(columns), f"{folder}/documents.parquet", row_group_size=50)
    pq.write_table(pa.table({"doc_id": pa.array([x[0] for x in labels], pa.int64()), "quality": pa.array([x[1] for x in labels], pa.int32()), "toxic": pa.array([x[2] for x in labels], pa.int32())}), f"{folder}/labels.parquet")
    pq.write_table(pa.table({"vec_id": pa.array([x[0] for x in vectors], pa.int64()), "embedding": pa.array([x[1] for x in vectors], pa.list_(pa.float32())), "label": pa.array([0] * len(vectors), pa.int32())}), f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def docs():
    found = pq.read_table(f"{DATA}/documents.parquet").to_pandas()
    return [*((int(i) + 1_000, t) for i, t in zip(found["doc_id"], found["text"])), *ODD]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    some = [(k, rng.normal(size=8).astype(np.float32).tolist()) for k in range(160)]
    some += [(50, some[3][1]), (50, rng.normal(size=8).tolist()), (300, some[0][1]), (301, some[0][1]), (350, [2 * x for x in some[0][1]])]
    return some + [(400, None), (450, [0.0] * 8), (500, [math.nan] * 8), (550, [math.inf] * 8), (600, [None] * 8), (650, []), (None, some[1][1]), (700, [1.0, 2.0]), (701, [1.0, 3.0])]


@pytest.fixture(scope="module")
def odd(tmp_path_factory, docs, vectors):
    labels = pq.read_table(f"{DATA}/labels.parquet").to_pandas()
    rows = [(int(r.doc_id) + 1_000, int(r.quality), int(r.toxic)) for r in labels.itertuples()]
    return tables(tmp_path_factory.mktemp("odd"), docs, [*rows, (8, 1, 0), (8, 0, 1), (9, None, None), (None, 1, 1), (BIG, 0, 0)], vectors)


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return tables(tmp_path_factory.mktemp("empty"), [], [], [])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables_give_no_row(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


def test_pipeline_over_empty_tables(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op2_nn_descent"}))
def test_every_document_has_its_row(spark, odd, docs, name):
    rows = QUERIES[name](spark, odd).select("doc_id").collect()
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(i for i, _ in docs)


def test_op2_by_brute_force(spark, odd, vectors):
    good = [(k, i, np.array(v, np.float32).astype(np.float64)) for k, (i, v) in enumerate(vectors) if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    cosine = lambda a, b: (a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))
    want = []
    for k, i, v in good:
        if i % 50 == 0:
            near = sorted((-cosine(v, w), j, m) for m, j, w in good if m != k and len(w) == len(v))[:5]
            want += [(i, n + 1, j, -s) for n, (s, j, _) in enumerate(near)]
    found = [tuple(r) for r in neighbours.op2_nn_descent(spark, odd).select("query_id", "rank", "vec_id", "score").collect()]
    assert sorted(x[:2] for x in found) == sorted(x[:2] for x in want)
    assert np.allclose(sorted(x[3] for x in found), sorted(x[3] for x in want), rtol=0, atol=1e-12)
    ties = lambda rows: collections.Counter((a, c, round(d, 9)) for a, _, c, d in rows)
    assert ties(found) == ties(want)
    for own in pd.DataFrame(found).groupby(0):
        assert own[1].sort_values(1)[3].is_monotonic_decreasing or len(set(own[1][1])) < len(own[1])


def test_op4_by_brute_force(spark, odd, docs):
    found = collections.defaultdict(list)
    for r in tiff.op4_tiff(spark, odd).collect():
        found[r.doc_id].append(r)
    for i, text in docs:
        data = (text or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 or 576 * (not data))
        own = next(r for r in found[i] if r.payload_sha256 == hashlib.sha256(payload).hexdigest())
        assert (own.n_bytes, own.payload_bytes, own.tail_crc32) == (len(data), len(payload), zlib.crc32(payload[-32:]))
        media = tiff.write_tiff(payload)
        assert (own.media_bytes, own.media_sha256) == (len(media), hashlib.sha256(media).hexdigest()) and own.feature == tiff.feature_of(payload)
        assert b"".join(page["pixels"] for page in tiff.pages_of(media)) == payload


def test_a_forged_header_is_an_error_row():
    media = bytearray(tiff.write_tiff(bytes(576 * 3)))
    for width, height in ((1 << 20, 1 << 31), (0, 5), (5, 0), ((1 << 32) - 1, (1 << 32) - 1)):
        forged = bytearray(media)
        at = int.from_bytes(forged[4:8], "little")
        for k in range(int.from_bytes(forged[at : at + 2], "little")):
            entry = at + 2 + 12 * k
            tag = int.from_bytes(forged[entry : entry + 2], "little")
            if tag in (256, 257):
                forged[entry + 2 : entry + 12] = (4).to_bytes(2, "little") + (1).to_bytes(4, "little") + (width if tag == 256 else height).to_bytes(4, "little")
        (page,) = tiff.pages_of(bytes(forged))
        assert page["error"] and page["pixels"] is None


@pytest.mark.parametrize("name", ["op5_toxicity", "op6_quality"])
def test_scores_follow_the_contract(spark, odd, docs, name):
    least = {"op5_toxicity": 0.5, "op6_quality": 0.3}[name]
    rows = QUERIES[name](spark, odd).collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= least)


def test_op6_by_a_plain_loop(spark, odd):
    import zstandard

    from crosslight.llm import quality
    from crosslight.llm.labelled import labelled_tables, remainder, training_rows

    documents, labels = labelled_tables(spark, odd)
    model = quality.learn(training_rows(documents, labels, "quality", remainder("doc_id", 5) == 0))
    assert model.good and model.bad
    rows = collections.Counter((r.doc_id, round(r.score, 12), r.good_bytes, r.bad_bytes) for r in quality.op6_quality(spark, odd).collect())
    want = collections.Counter()
    packers = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False) for d in (model.good, model.bad)]
    for r in documents.select("doc_id", "text").collect():
        data = (r.text or "").encode()
        good, bad = (sum(len(p.compress(data[a : a + 2_048])) for a in range(0, len(data), 2_048)) for p in packers)
        gain = (bad - good) / max(good + bad, 1)
        z = model.weights[0] * gain + model.weights[1] * gain * np.log1p(len(data)) / 10 + model.weights[2]
        want[r.doc_id, round(1 / (1 + math.exp(-min(30, max(-30, z)))), 12), good, bad] += 1
    assert rows == want


def test_op7_by_a_plain_dict_of_chunks(spark, odd):
    found = substrings.op7_substrings(spark, odd).collect()
    rows = spark.read.parquet(f"{odd}/documents.parquet").select("doc_id", "text").collect()  # in the table's order
    first, whole, want = {}, {}, []
    for k, (doc, text) in enumerate(rows):
        data = (text or "").encode()
        _, _, starts, stops, counts = substrings.chunks_of([data])
        keys = [xxh3_128_digest(data[a:b]) for a, b in zip(starts, stops)]
        seen, repeated = set(), []
        for key in keys:
            repeated.append(key in first or key in seen)
            seen.add(key)
        if data and counts.sum() < substrings.LEAST_WORDS and data in whole:
            want.append((doc, ""))
        else:
            keep, run = b"", []
            for a, b, n, again in [*zip(starts, stops, counts, repeated), (len(data), len(data), 0, False)]:
                if again:
                    run.append((a, b, n))
                    continue
                if sum(x[2] for x in run) < substrings.LEAST_WORDS:
                    keep += b"".join(data[x:y] for x, y, _ in run)
                run, keep = [], keep + data[a:b]
            want.append((doc, None if text is None else keep.decode()))
        for key in keys:
            first.setdefault(key, k)
        if data and counts.sum() < substrings.LEAST_WORDS:
            whole.setdefault(data, k)
    assert collections.Counter((r.doc_id, r.text) for r in found) == collections.Counter(want)


def test_op8_law(spark, odd, docs):
    found = QUERIES["op8_sharding"](spark, odd).toPandas()
    assert set(found["law"]) == {"bytes"} and found["grown_shard"].isna().all() and set(found["shard"]) <= set(range(8))
    assert sorted(found["size"]) == sorted(len((t or "").encode()) + 1 for _, t in docs)
    for _, own in found.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))


def test_op9_against_the_library(spark, odd, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    want = collections.Counter()
    for i, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    found = QUERIES["op9_bpe"](spark, odd).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert collections.Counter(tuple(r) for r in found) == want


def test_op10_contract(spark, odd):
    for r in QUERIES["op10_langid"](spark, odd).collect():
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 1)
        assert r.lang_pred in ("en", "de", "und") and 0 <= r.score <= 1


def similar_texts():
    """Two clusters with more and less edited members, and texts that resemble none."""
    rng, texts = random.Random(12), []
    for c in range(2):
        base = [f"c{c}w{k}" for k in range(90)]
        for _ in range(130):
            own = list(base)
            for at in rng.sample(range(90), rng.choice((0, 1, 1, 2, 2, 3, 4, 6))):
                own[at] = f"e{rng.randrange(10**9)}"
            texts.append(" ".join(own))
    return texts + [" ".join(f"r{rng.randrange(10**9)}" for _ in range(60)) for _ in range(40)]


@pytest.mark.parametrize("members", [1_024, 32])
def test_one_bucket_of_all_links_as_brute_force_does(spark, monkeypatch, members):
    monkeypatch.setattr(minhash, "MEMBERS", members)
    texts, known = list(dict.fromkeys(similar_texts())), minhash.Hashes()
    idf = minhash.inverse_frequencies(np.zeros(minhash.BUCKETS, np.int64), 1)
    bags = [minhash.shingles(words(t), idf, known) for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if root[a] != root[b] and minhash.weighted_jaccard(bags[a], bags[b]) >= 0.8:
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    packed = spark.createDataFrame([(k, bytearray(n.tobytes()), bytearray(w.astype(np.float32).tobytes())) for k, (n, w) in enumerate(bags)], "row long, names binary, weights binary")
    own = dict(minhash.own_weights(packed).collect())
    rows = [(k, float(w.sum()), float(own.get(k, 0.0)), [5] * 3, 0, 5) for k, (_, w) in enumerate(bags)]
    table = spark.createDataFrame(rows, "row long, weight double, own double, keys array<long>, band int, key long")
    table = table.where(f"weight - own >= 0.8 * weight * {1 - 1e-6}")
    hubs = minhash.hubs_of(table)
    stars = table.join(hubs, ["band", "key"]).where("row <> hub").selectExpr("hub AS a", "row AS b")
    links = minhash.verified(stars, packed, 0.8)
    more = minhash.bucket_links(table, hubs, components(links), packed, 0.8)
    found = dict(components(links.union(more)).collect())
    assert [found.get(k, k) for k in range(len(texts))] == root
    assert len(set(root)) > 45 and table.count() < len(texts) - 40


def test_two_thousand_near_copies_are_one_class(spark):
    rng, base = random.Random(3), [f"w{k}" for k in range(104)]
    texts = [" ".join(f"e{k}" if j == at else w for j, w in enumerate(base)) for k, at in enumerate(rng.choices(range(104), k=2_000))]
    texts += [" ".join(f"x{rng.randrange(10**9)}" for _ in range(50)) for _ in range(50)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = minhash.near_duplicates(frame).toPandas()
    sizes = found.groupby("class_id").size()
    assert sizes[0] == 2_000 and (sizes.drop(0) == 1).all() and found["first"].sum() == 51


def test_kept_rows_keep_their_columns(spark, odd):
    rows = spark.read.parquet(f"{odd}/documents.parquet")
    for stage in (corpus_pipeline.near_dedup, corpus_pipeline.substring_dedup, corpus_pipeline.mix_domains, corpus_pipeline.reject_toxic):
        out = stage(spark, rows, odd)
        assert out.columns == rows.columns and out.where("_row <> 'clash' OR row <> 'clash' OR score <> 'clash' OR rate <> 'clash'").count() == 0


def test_pipeline_over_odd_rows(spark, odd, docs):
    rows = corpus_pipeline.run(spark, odd).collect()
    assert {r.doc_id for r in rows} <= {i for i, _ in docs} and BIG in {r.doc_id for r in rows} | {None, BIG}
    assert len(rows) > 100
