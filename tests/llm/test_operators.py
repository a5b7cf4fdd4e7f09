"""The training-data operators against brute force, exact round trips and held-out accuracy, with odd input."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from crosslight.llm import bpe, langid, minhash, mixing, neighbours, quality, sharding, substrings, tiff, toxicity
from crosslight.llm.common import words
from crosslight.llm.graphs import components
from crosslight.llm.labelled import training_rows
from crosslight.llm.queries import SHARDS_SQL
from tests.compare import DATA, connection

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row string, shard string"


def docs_of(spark, texts, ids=None):
    ids = ids if ids is not None else range(len(texts))
    return checkpointed(spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", "clash") for i, t in zip(ids, texts)], DOCS))


def checkpointed(frame):
    from crosslight.llm.common import cut

    return cut(frame)


ODD = [None, "", " \n", "a", "a", "ÄÖ ΣΑΣ ǅ 한글 ́", "x" * 5_000, "word " * 3_000, "\x00�", "<|endoftext|>it's 12½"]
ODD_IDS = [None, 1, 1, 2, 2, 3, 4, 5, 6, None]


def test_shards_are_contiguous_and_balanced(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = sharding.balanced_shards(docs, 8).toPandas().sort_values("doc_id")
    con = connection()
    want = con.execute(SHARDS_SQL).df().sort_values("doc_id")
    for column in ("doc_id", "size", "shard", "slot"):
        assert found[column].tolist() == want[column].tolist()
    sizes = found.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() <= 2 * found["size"].max()
    texts = docs.toPandas().set_index("doc_id")["text"]
    assert all(zlib.crc32((texts[i] or "").encode()) == c for i, c in zip(found["doc_id"], found["text_crc32"]))


def test_shards_of_odd_rows(spark):
    found = sharding.balanced_shards(docs_of(spark, ODD, ODD_IDS), 3).toPandas()
    assert len(found) == len(ODD)
    for _, group in found.groupby("shard"):
        assert sorted(group["slot"]) == list(range(len(group)))
    assert sharding.balanced_shards(docs_of(spark, []), 3).count() == 0
    with pytest.raises(ValueError):
        sharding.balanced_shards(docs_of(spark, []), 0)


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    return path, Tokenizer.from_file(path)


def test_bpe_is_the_library_s(spark):
    path, library = tokenizer()
    random.seed(1)
    letters = "aAéΣİßſKÅ'stvmlred \x1c\x85\t!?<|>12²½Ⅷ한中😀́‍　 ǅ"
    texts = ODD + ["".join(random.choices(letters, k=random.randint(0, 30))) for _ in range(400)]
    texts += spark.read.parquet(f"{DATA}/documents.parquet").limit(60).toPandas()["text"].tolist()
    docs = docs_of(spark, texts)
    coded = bpe.encode(docs, path)
    rows = {r.doc_id: r for r in coded.collect()}
    again = {r.doc_id: r.decoded for r in bpe.decode(checkpointed(coded.select("doc_id", "ids")), path).collect()}
    digests = {r.doc_id: r for r in bpe.encode(docs, path, digests=True).collect()}
    for k, text in enumerate(texts):
        want = library.encode(text or "", add_special_tokens=False)
        decoded = library.decode(want.ids, skip_special_tokens=False)
        assert (rows[k].ids, rows[k].n_tokens, rows[k].decoded, again[k]) == (want.ids, len(want.ids), decoded, decoded)
        assert digests[k].ids_sha256 == hashlib.sha256(" ".join(map(str, want.ids)).encode()).hexdigest()
        assert digests[k].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.encode(docs_of(spark, ODD, ODD_IDS), path).count() == len(ODD)
    assert bpe.encode(docs_of(spark, []), path).count() == 0


def test_bpe_of_a_word_of_very_many_ids(spark):
    path, library = tokenizer()
    texts = ["한" * 70_000, "short"]
    found = {r.doc_id: r.ids for r in bpe.encode(docs_of(spark, texts), path).collect()}
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(want[0]) > 65_535 and [found[0], found[1]] == want


@pytest.mark.parametrize("size", [0, 1, 2, 254, 257, 511, 576, 3_838, 3_839, 9_216, 40_000])
def test_codecs_round_trip(size):
    random.seed(size)
    for data in (random.randbytes(size), bytes(size), (b"abc" * size)[:size], bytes(random.choices(b"aab", k=size))):
        assert tiff.lzw_decode(tiff.lzw_encode(data)) == data
        assert tiff.packbits_decode(tiff.packbits_encode(data)) == data


def test_tiff_pages(spark):
    rng = np.random.default_rng(3)
    payloads = [rng.integers(0, 256, 576 * n, dtype=np.uint8).tobytes() for n in (1, 2, 13, 16, 17, 64, 65, 200)]
    files = [tiff.write_tiff(p) for p in payloads] + [None, b"", b"II*\0", b"II*\0" + b"\xff" * 40, tiff.write_tiff(payloads[3])[:-30]]
    rows = spark.createDataFrame([(k, None if f is None else bytearray(f)) for k, f in enumerate(files)], "k int, content binary")
    pages = tiff.read_pages(rows, keep=("k",)).toPandas()
    for k, payload in enumerate(payloads):
        own = pages[pages["k"] == k].sort_values("page")
        assert own["error"].isna().all() and b"".join(own["pixels"]) == payload
        assert own["page"].tolist() == list(range(-(-len(payload) // (576 * 64))))
    broken = pages[pages["k"] >= len(payloads)]
    assert broken.groupby("k")["error"].apply(lambda e: e.notna().any()).all() and broken["k"].nunique() == 5
    assert {1, 5, 8, 32773} & set(pages["compression"].dropna()) >= {5, 8, 32773} and pages["tiled"].dropna().any()


def test_tiff_big_endian_planar_16_bits():
    import struct

    samples = np.arange(2 * 3 * 2, dtype=np.uint16).reshape(2, 2, 3)  # planes, rows, columns
    planes = [np.diff(p, axis=1, prepend=np.zeros((2, 1), np.uint16)).astype(">u2").tobytes() for p in samples]
    body = b"".join(planes)
    tags = [(256, 3, 3), (257, 3, 2), (258, 3, 16), (259, 3, 1), (273, 4, None), (277, 3, 2), (278, 3, 2), (279, 4, None), (284, 3, 2), (317, 3, 2)]
    at = 8 + len(body)
    extra = at + 2 + 12 * len(tags) + 4
    data = b"MM\0*" + struct.pack(">I", at) + body + struct.pack(">H", len(tags))
    for tag, kind, value in tags:
        if value is None:
            data += struct.pack(">HHII", tag, kind, 2, extra + (8 if tag == 279 else 0))
        else:
            data += struct.pack(">HHIHH", tag, kind, 1, value, 0)
    data += struct.pack(">I", 0) + struct.pack(">II", 8, 8 + len(planes[0])) + struct.pack(">II", len(planes[0]), len(planes[1]))
    (page,) = tiff.pages_of(data)
    assert page["error"] is None
    assert (np.frombuffer(page["pixels"], ">u2").reshape(2, 3, 2) == samples.transpose(1, 2, 0)).all()


def test_texts_as_media(spark):
    found = {r.doc_id: r for r in tiff.read_pages(tiff.texts_as_tiff(docs_of(spark, ODD)), keep=("doc_id", "n_bytes")).where("page = 0").collect()}
    for k, text in enumerate(ODD):
        data = (text or "").encode()
        assert found[k].n_bytes == len(data) and found[k].pixels[: len(data)] == data[: 576 * 64] and set(found[k].pixels[len(data) :]) <= {255}


def brute_segments(scores):
    """All maximal scoring segments by their definition: the best one, then the same on either side."""
    out = []

    def split(a, b):
        total = np.r_[0.0, np.cumsum(scores[a:b])]
        best, where = 0.0, None
        for i, j in itertools.combinations(range(len(total)), 2):
            if total[j] - total[i] > best + 1e-12 or (where and abs(total[j] - total[i] - best) < 1e-12 and j - i < where[1] - where[0]):
                best, where = total[j] - total[i], (i, j)
        if where:
            out.append((a + where[0], a + where[1]))
            split(a, a + where[0])
            split(a + where[1], b)

    split(0, len(scores))
    return sorted(out)


def test_segments_are_all_maximal_ones():
    rng = np.random.default_rng(5)
    for _ in range(150):
        scores = rng.normal(-0.2, 1, rng.integers(0, 25))
        found = toxicity.segments(scores)
        assert sorted((a, b) for a, b, _ in found) == brute_segments(scores)
        assert max([0.0, *(s for *_, s in found)]) == pytest.approx(toxicity.highest(scores))


def labelled(spark, n=400):
    rng = random.Random(3)
    bank = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    texts, labels = [], []
    for k in range(n):
        tokens = rng.choices(bank, k=rng.randint(20, 120))
        toxic, bad = k % 5 == 0, k % 3 == 0
        if toxic:
            at = rng.randrange(len(tokens))
            tokens[at:at] = rng.choices(["vile", "scum", "fool"], k=6)
        if bad:
            tokens = [w.upper() + "!!" for w in tokens] + rng.choices(["CLICK!!", "HERE!!", "NOW!!"], k=8)
        texts.append(" ".join(tokens))
        labels.append((k, int(not bad), int(toxic)))
    return docs_of(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_toxicity_and_quality_on_held_out_rows(spark):
    docs, labels, known = labelled(spark)
    held = F.col("doc_id") % 4 == 0
    model = toxicity.learn(training_rows(docs, labels, "toxic", held))
    found = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    out = [k for k in known if k[0] % 4 == 0]
    assert np.mean([(found[k].score >= 0.5) == bool(t) for k, _, t in out]) >= 0.95
    texts = {r.doc_id: words(r.text) for r in docs.collect()}
    inside = [{"vile", "scum", "fool"} & set(texts[k][p.start : p.end]) for k, _, t in out if t for p in found[k].passages]
    assert inside and all(inside)
    model = quality.learn(training_rows(docs, labels, "quality", held))
    found = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert np.mean([(found[k] >= 0.5) == bool(q) for k, q, _ in out]) >= 0.95


@pytest.mark.parametrize("part", [toxicity, quality])
def test_classifiers_on_odd_rows(spark, part):
    empty = training_rows(docs_of(spark, []), spark.createDataFrame([], "doc_id long, toxic int"), "toxic")
    one = training_rows(docs_of(spark, ["a b", None]), spark.createDataFrame([(0, 1), (1, 1), (1, None), (None, 0)], "doc_id long, toxic int"), "toxic")
    for rows in (empty, one):
        found = part.score(docs_of(spark, ODD, ODD_IDS), part.learn(rows)).collect()
        assert len(found) == len(ODD) and all(0 <= r.score <= 1 for r in found)
    assert part.score(docs_of(spark, []), part.learn(empty)).count() == 0


def test_languages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    learned = langid.learn(docs.where("doc_id % 3 <> 1"))
    rows = langid.predict(docs.where("doc_id % 3 = 1"), learned).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) >= 0.97 and all(0 <= r.score <= 1 for r in rows)
    odd = {(r.doc_id, r.lang_pred) for r in langid.predict(docs_of(spark, [None, "", "12 !", "x"]), learned).collect()}
    assert {(0, "und"), (1, "und"), (2, "und")} <= odd
    assert {r.lang_pred for r in langid.predict(docs_of(spark, ODD), langid.learn(docs.limit(0))).collect()} == {"und"}


def test_phrases_by_brute_force():
    reference, text = "the cat sat on the mat with a hat", "that cat on a mat sat zz"
    rng = random.Random(2)
    alphabets = ["ab c", "aбв é", "".join(chr(c) for c in range(0x4E00, 0x4E0C)) + " "]
    texts = [" ".join("".join(rng.choices(a, k=n)).split()) for a in alphabets for n in (6, 40, 1_500, 5_000)] + [text]
    references = (reference, "".join(rng.choices(alphabets[0], k=900)), "".join(rng.choices(alphabets[2] + "б", k=900)))
    counts, sizes, letters = langid.phrase_counts([*texts, *texts, "!", ""], references)
    for k, own in enumerate([*texts, *texts]):
        data = f"{own} ".encode()  # the line break between two texts is a blank of the first
        for j, known in enumerate(x.encode() for x in references):
            n, at = 0, 0
            while at < len(data):
                size = 1
                while at + size < len(data) and data[at : at + size + 1] in known:
                    size += 1
                n, at = n + 1, at + size
            assert counts[k, j] == n
        assert sizes[k] == len(data)
    assert letters.tolist() == [*[True] * 2 * len(texts), False, False]


def test_languages_of_scripts_with_many_letters(spark):
    rng = random.Random(4)
    one, two = ([chr(c) for c in range(a, a + 300)] for a in (0x4E00, 0xAC00))
    rows = [(k, "".join(rng.choices((one, two)[k % 2], k=200)), "xy"[k % 2]) for k in range(120)]
    docs = checkpointed(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    found = langid.predict(docs.where("doc_id >= 60"), langid.learn(docs.where("doc_id < 60"))).collect()
    assert [r.lang_pred for r in found] == ["xy"[r.doc_id % 2] for r in found] and min(r.score for r in found) > 0.05


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(2)
    near = rng.normal(size=(20, 16))
    vectors = np.r_[near[rng.integers(0, 20, 500)] + 0.2 * rng.normal(size=(500, 16)), rng.normal(size=(300, 16))]
    rows = [(k, list(map(float, v)), 0) for k, v in enumerate(vectors)] + [(1_000 + k, list(map(float, vectors[0])), 0) for k in range(40)]
    rows += [(2_000, None, 0), (2_050, [0.0] * 16, 0), (2_100, [float("nan")] * 16, 0), (2_150, [1.0], 0), (None, [1.0] * 16, 0), (2_200, [None] * 16, 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    found = neighbours.nearest(frame, F.col("vec_id") % 50 == 0).toPandas()
    good = [r for r in rows if r[0] is not None and r[0] < 2_000]
    ids, matrix = np.array([r[0] for r in good]), np.array([r[1] for r in good])
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    hit = n = 0
    for q in np.flatnonzero(ids % 50 == 0):
        sims = np.round(unit @ unit[q], 12)
        sims[q] = -2
        want = ids[np.lexsort((ids, -sims))[:5]]
        own = found[found["query_id"] == ids[q]].sort_values("rank")
        assert own["rank"].tolist() == [1, 2, 3, 4, 5]
        hit, n = hit + len(set(want) & set(own["vec_id"])), n + 5
    assert hit / n >= 0.9 and set(found["query_id"]) == set(ids[ids % 50 == 0])
    few = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r)[:3] for r in neighbours.nearest(few, F.col("vec_id") % 50 == 0).collect()) == [(0, 1, 50), (50, 1, 0)]


def test_neighbours_in_more_clusters_than_entries(spark):
    rng = np.random.default_rng(8)
    vectors = np.repeat(rng.normal(size=(600, 16)), 30, axis=0) + 0.02 * rng.normal(size=(18_000, 16))
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = neighbours.nearest(frame, F.col("vec_id") % 50 == 0).toPandas().groupby("query_id")["vec_id"].apply(set)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 18_000, 50):
        sims = unit @ unit[q]
        sims[q] = -2
        hit += len(found[q] & set(np.argsort(-sims)[:5].tolist()))
    assert hit / (5 * 360) >= 0.98


def near_copies():
    rng = random.Random(9)
    fresh = lambda n: [f"w{rng.randrange(4_000)}" for _ in range(n)]
    texts, group = [], []
    for g in range(25):
        base = fresh(rng.randint(60, 200))
        for _ in range(rng.choice((1, 2, 5, 30 if g == 0 else 3))):
            own = list(base)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = f"e{rng.randrange(9_999)}"
            texts.append(" ".join(own))
            group.append(g)
    return texts, group


def test_near_duplicates_against_brute_force(spark):
    texts, group = near_copies()
    docs = docs_of(spark, texts)
    found = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    idf = minhash.inverse_frequencies(*minhash.document_frequencies(docs, "text"))
    known = minhash.Hashes()
    bags = [minhash.shingles(words(t), idf, known) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if minhash.weighted_jaccard(bags[a], bags[b]) >= 0.8:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    assert [found[k].class_id for k in range(len(texts))] == [root(k) for k in range(len(texts))]
    assert sum(r.first for r in found.values()) == len({root(k) for k in range(len(texts))})
    assert len({(g, found[k].class_id) for k, g in enumerate(group)}) >= len(set(group))


def test_large_buckets_are_compared_whole(spark, monkeypatch):
    """Two similar texts that share one band only, in a bucket of several hundred others that resemble neither enough."""
    even = (np.zeros(minhash.BUCKETS, np.int64), 1)  # all words weigh the same
    monkeypatch.setattr(minhash, "document_frequencies", lambda docs, text_col: even)
    rng, sampler, known, idf = random.Random(5), minhash.Sampler(), minhash.Hashes(), minhash.inverse_frequencies(*even)
    base = [f"w{k}" for k in range(104)]

    def edited(places):
        return " ".join(f"e{rng.randrange(10**9)}" if k in places else w for k, w in enumerate(base))

    def signed(text):
        bag = minhash.shingles(words(text), idf, known)
        return bag, sampler.bands(*bag)

    for _ in range(40_000):
        one, two = edited({20}), edited({0, rng.randrange(30, 99)})
        (bag_a, keys_a), (bag_b, keys_b) = signed(one), signed(two)
        if (keys_a == keys_b).sum() == 1 and minhash.weighted_jaccard(bag_a, bag_b) >= 0.8:
            break
    band = int(np.flatnonzero(keys_a == keys_b)[0])
    others = []
    while len(others) < 300:
        text = edited(set(rng.sample(range(104), 5)))
        bag, keys = signed(text)
        if keys[band] == keys_a[band] and max(minhash.weighted_jaccard(bag, x) for x in (bag_a, bag_b)) < 0.8:
            others.append(text)
    texts = [*others, one, two]
    bags = [signed(t)[0] for t in texts]
    assert (keys_a == keys_b).sum() == 1 and not any(minhash.weighted_jaccard(a, b) >= 0.8 for a, b in itertools.combinations(bags[:-1], 2))
    found = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs_of(spark, texts)).collect()}
    assert found == {k: k for k in range(301)} | {301: 300}


def test_samples_agree_as_often_as_similar():
    rng, sampler = np.random.default_rng(1), minhash.Sampler()
    agree = []
    for _ in range(200):
        names = np.unique(rng.integers(0, 1 << 62, 100, dtype=np.uint64))
        weights = rng.uniform(1, 5, len(names))
        a, b = (names[:-5], weights[:-5]), (names[5:], weights[5:] * 1.1)
        agree.append((np.mean(sampler.bands(*a) == sampler.bands(*b)), minhash.weighted_jaccard(a, b) ** minhash.ROWS))
    seen, expected = np.mean(agree, axis=0)
    assert abs(seen - expected) < 0.05


def test_near_duplicates_of_odd_rows(spark):
    found = minhash.near_duplicates(docs_of(spark, ODD, ODD_IDS)).collect()
    assert len(found) == len(ODD) and sum(r.class_size for r in found if r.first) == len(ODD)
    kept = minhash.keep_one(docs_of(spark, ODD, ODD_IDS))
    assert kept.columns == docs_of(spark, []).columns and kept.where("text = 'a'").count() == 1 and kept.where("coalesce(text, '') = ''").count() == 1
    assert minhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 101), (101, 100)], "a long, b long")
    roots = dict(components(links).collect())
    assert {roots[k] for k in range(51)} == {0} and roots[101] == 100


def test_repeated_passages_go(spark):
    rng = random.Random(4)
    fresh = lambda n: [f"w{rng.randrange(50_000)}" for _ in range(n)]
    passage = fresh(60)
    texts = [" ".join(fresh(rng.randint(5, 80)) + passage + fresh(rng.randint(5, 80))) for _ in range(20)] + [" ".join(fresh(100)) for _ in range(20)]
    texts += [texts[25]] * 3
    rows = substrings.remove_repeats(docs_of(spark, texts))
    found = {r.doc_id: r for r in rows.collect()}
    split = [r.text.split() for r in found.values()]
    grams = collections.Counter(g for w in split for g in {tuple(w[i : i + 51]) for i in range(max(0, len(w) - 50))})
    assert not [g for g, n in grams.items() if n > 1]
    assert all(found[k].text == texts[k] and not found[k].repeats_of for k in range(20, 40))
    assert all(0 in found[k].repeats_of for k in range(1, 20)) and all(found[k].text == "" for k in range(40, 43))
    for k, r in found.items():
        data, cut = texts[k].encode(), b""
        end = 0
        for span in r.removed_spans:
            cut, end = cut + data[end : span.start], span.end
        assert (cut + data[end:]).decode() == r.text


def test_repeats_without_ascii_blanks_go(spark):
    rng = random.Random(7)
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(n))
    spaced = lambda n, blank: blank.join(f"w{rng.randrange(50_000)}" for _ in range(n))
    passage, wide = han(300), spaced(60, "\u3000")
    texts = [han(200) + passage + han(200), han(150) + passage + han(250), spaced(20, "\xa0") + "\u3000" + wide + "\u3000" + spaced(20, "\xa0")]
    texts += [spaced(30, "\u2003") + "\u3000" + wide + "\u3000" + spaced(20, "\xa0"), texts[0], "three short words", "three short words", "three short", " "]
    found = {r.doc_id: r for r in substrings.remove_repeats(docs_of(spark, texts)).collect()}
    assert [found[k].text == texts[k] for k in (0, 2, 5, 7, 8)] == [True] * 5 and found[4].text == found[6].text == ""
    assert found[1].removed_bytes > 0.75 * len(passage.encode()) and found[1].repeats_of == [0]
    assert found[3].removed_bytes > 0.6 * len(wide.encode()) and found[3].repeats_of == [2] and found[6].repeats_of == [5]
    assert all(len(r.text.encode()) + r.removed_bytes == len(texts[k].encode()) for k, r in found.items())


def test_chunks_resist_shifts():
    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(9_999)}" for _ in range(500)).encode()
    pieces = lambda t: {t[a:b] for a, b in zip(*(x.tolist() for x in substrings.chunks_of([t])[2:4]))}
    before, after = pieces(text), pieces(b"inserted here " + text)
    assert len(before & after) >= len(before) - 4
    _, _, starts, stops, counts = substrings.chunks_of([text])
    assert b"".join(text[a:b] for a, b in zip(starts, stops)) == text and counts.sum() == 500


def test_substrings_of_odd_rows(spark):
    docs = docs_of(spark, ODD, ODD_IDS)
    out = substrings.remove_repeats(docs)
    assert out.columns == [*docs.columns, "removed_bytes", "removed_spans", "repeats_of"] and out.count() == len(ODD)
    assert out.where("text IS NULL").count() == 1
    assert substrings.remove_repeats(docs_of(spark, [])).count() == 0


def test_mixing_meets_its_targets(spark):
    rng, texts, labels = random.Random(6), [], []
    for k in range(300):
        domain = (0, 0, 0, 1, 1, 2)[k % 6]
        texts.append(" ".join(rng.choices([f"common{i}" for i in range(40)], k=20) + rng.choices([f"own{domain}x{i}" for i in range(20)], k=20)))
        labels.append((k, int(domain != 1), int(domain == 2)))
    docs, labels = docs_of(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = mixing.learn(mixing.domain_rows(docs, labels))
    targets = {"high": 0.6, "low": 0.3, "toxic": 0.1}
    for least, growth in ((0.0, 1.0), (1.0, 2.0)):
        found = mixing.mix(docs, model, targets, least, growth).toPandas()
        p, size, rate = np.stack(found["posterior"]), found["n_tokens"].to_numpy(float), found["rate"].to_numpy()
        assert (rate >= least - 1e-9).all() and np.allclose(p.sum(axis=1), 1)
        totals = (rate * size) @ p
        assert np.abs(totals / totals.sum() - np.array([0.6, 0.3, 0.1])).max() < 0.02 and abs(totals.sum() / size.sum() - growth) < 0.02
    taken = mixing.take(docs, model, targets, least=1.0, growth=2.0)
    assert taken.columns == docs.columns and taken.select("doc_id").distinct().count() == docs.count()
    odd = mixing.mix(docs_of(spark, ODD, ODD_IDS), model, targets).collect()
    assert len(odd) == len(ODD) and all(r.rate >= 0 for r in odd)
    assert mixing.mix(docs_of(spark, []), model, targets).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, model, {"high": 0.0})
