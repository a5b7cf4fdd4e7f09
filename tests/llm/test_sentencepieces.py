"""SentencePiece encoding, spans and decoding against the library, with the public model and with character maps built here."""

from __future__ import annotations

import hashlib
import random
import struct

import pyarrow.parquet as pq
import pytest
import sentencepiece

from crosslight.llm import sentencepieces as sps
from tests.compare import DATA

WORDS = ["ab", "et", " ", "  ", "in", "▁", "\n", "漢", "é", "́", "𐍈", "😀", "<s>", "0x1", "ﬁ", "½", "Å", " ", "　", "ing", "tion", "\x00", "\t", "é"]


@pytest.fixture(scope="module")
def data():
    import public_tokenizers

    return open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()


def spans(library, text):
    """(id, begin, end) of every piece, as the library's own serialised result has them."""
    pieces = [dict(sps.proto(v)) for k, v in sps.proto(library.encode(text, out_type="serialized_proto")) if k == 2]
    return [(p[2], p.get(4, 0), p.get(5, 0)) for p in pieces]


def differs(model, library, text):
    joined, ids, begins, ends = sps.encode_text(text, model)
    want = spans(library, text)
    same = list(zip(ids.tolist(), begins.tolist(), ends.tolist())) == want and joined == ",".join(str(w[0]) for w in want)
    return not same or sps.decode_ids(ids.tolist(), model) != library.decode([w[0] for w in want])


def texts(seed, n):
    dice = random.Random(seed)
    fixed = ["", " ", "   ", "a", "▁", "▁▁ b", "\x00", " \n\t x ", "a" * 3_000, "ab" * 2_000 + " " * 100 + "x", "字" * 2_000, "word " * 9_000, "x\n\n\ny"]
    return fixed + ["".join(dice.choice(WORDS) for _ in range(dice.randrange(30))) for _ in range(n)]


def test_pieces_and_spans_are_the_librarys(data):
    model, library = sps.model_of(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    assert not [t[:40] for t in texts(1, 800) if differs(model, library, t)]


def test_decoding_any_ids_is_the_librarys(data):
    model, library, dice = sps.model_of(data), sentencepiece.SentencePieceProcessor(model_proto=data), random.Random(2)
    for _ in range(800):
        kinds = (lambda: dice.randrange(32_000), lambda: dice.randrange(3, 259), lambda: dice.choice([0, 1, 2, 259, 28_705]))
        ids = [dice.choice(kinds)() for _ in range(dice.randrange(12))]
        assert sps.decode_ids(ids, model) == library.decode(ids)


def compiled(pairs):
    """A character map in the compiled form: each node's children lie in 256 units of their own."""
    texts_, starts = b"", {}
    for _, put in pairs:
        starts[put] = len(texts_)
        texts_ += put.encode() + b"\0"
    trie, nodes = {}, []
    for key, put in pairs:
        node = trie
        for byte in key.encode():
            node = node.setdefault(byte, {})
        node[None] = starts[put]
    units = {}

    def lay(node, place, label):
        nodes.append(node)
        base = 256 * len(nodes)
        units[place] = label | (None in node) << 8 | (place ^ base) << 10
        if None in node:
            units[base] = node[None] | 1 << 31
        for byte in sorted(k for k in node if k is not None):
            lay(node[byte], base ^ byte, byte)

    lay(trie, 0, 0)
    flat = [units.get(k, 0) for k in range(256 * (len(nodes) + 1))]
    return struct.pack(f"<I{len(flat)}I", 4 * len(flat), *flat) + texts_


def number(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def with_map(data, charmap, prefix, trim):
    """The model with another normaliser: its character map, the space in front, and whether further spaces go."""
    spec = b"\x0a\x04mine" + (b"\x12" + number(len(charmap)) + charmap) + bytes([24, prefix, 32, trim, 40, 1])
    out = b""
    for key, value in sps.proto(data):
        if key == 3:
            value = spec
        out += number(key << 3 | 2) + number(len(value)) + value
    return out


MAP = [("ﬁ", "fi"), ("½", "1/2"), ("Å", "Å"), ("Å", "Å"), ("A", "a"), (" ", " "), ("　", " "), ("\n", " "), ("\t", " "), ("ab", "B b"), ("abet", "x"), ("é", ""), ("​", "")]


@pytest.mark.parametrize("prefix", [0, 1])
@pytest.mark.parametrize("trim", [0, 1])
def test_character_maps(data, prefix, trim):
    """Longest prefixes win, replacements may be longer, shorter, empty or hold spaces, and spans still lie in the original."""
    own = with_map(data, compiled(MAP), prefix, trim)
    model, library = sps.model_of(own), sentencepiece.SentencePieceProcessor(model_proto=own)
    assert model.map.longest("abetx".encode(), 0) == (4, b"x") and model.map.longest(b"abe", 0) == (2, b"B b") and model.map.longest(b"zz", 0) is None
    assert not [t[:40] for t in texts(3, 500) if differs(model, library, t)]


def test_merging_side_by_side_is_merging_one_by_one(data):
    model, dice = sps.model_of(data), random.Random(4)
    parts = list({"▁" * dice.randrange(4) + "".join(dice.choice("theinrsaoé漢0.") for _ in range(dice.randrange(1, 60))) for _ in range(2_000)})
    for part, coded in sps.code_segments(parts, model).items():
        assert coded == sps._coded(sps.merged(part, model), model)


def test_a_part_is_merged_once_in_a_batch(data, monkeypatch):
    model, seen = sps.model_of(data), []
    model.known.clear()
    real = sps.code_segments
    monkeypatch.setattr(sps, "code_segments", lambda segments, m: seen.extend(segments) or real(segments, m))
    for _ in range(2):
        list(sps.encode_texts(["one two one", "two three two", "y" * 500], model))
    assert sorted(s for s in seen if len(s) < 65) == ["▁one", "▁three", "▁two"] and len(model.known) == 3


def test_other_kinds_of_models_are_refused(data):
    with pytest.raises(ValueError, match="reads models"):
        sps.model_of(b"".join(number(k << 3 | 2) + number(len(v)) + v for k, v in sps.proto(data) if k != 2))


def test_lists_and_decoding_of_a_table(spark, data):
    import public_tokenizers

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    rows = [(None, "null id"), (1, None), (2, ""), (2, "same id é漢"), (2, "same id é漢"), ((1 << 62) + 1, " tail\n")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, decoded string").repartition(2)
    coded = sps.encode(docs, path)
    got = sorted((r.doc_id or -1, r.n_tokens, tuple(r.ids), r.decoded) for r in coded.collect())
    want = sorted((i or -1, len(x := library.encode(t or "")), tuple(x), library.decode(x)) for i, t in rows)
    assert got == want
    assert sorted(r.decoded for r in sps.decode(coded, path).collect()) == sorted(w[3] for w in want)
    for r in coded.where("doc_id = 2 AND n_tokens > 0").collect():
        raw = "same id é漢".encode()
        assert b"".join(raw[a:b] for a, b in zip(r.begins, r.ends)) == raw
    assert sps.encode(docs.limit(0), path).count() == 0


def test_op11_over_the_whole_table(spark, data):
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    docs = pq.read_table(f"{DATA}/documents.parquet").to_pydict()
    want = {}
    for doc_id, text in zip(docs["doc_id"], docs["text"]):
        ids = library.encode(text or "")
        want[doc_id] = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), len((text or "").encode()))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.span_bytes) for r in sps.op11_sentencepiece(spark, str(DATA)).collect()}
    assert got == want
