import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessel.llm import bpe_codec, chunks, packing, token_counts, token_files
from tessel.llm.common import scratch_path
from tessel.llm.encoders import Generations, piece_encoder

TEXTS = [
    (3, "Hello  world,\n\n it's  two   blanks\t and tabs. "),
    (1, None),
    (2, ""),
    (5, "the same row"),
    (5, "the same row"),
    (9, "é ü 中文 🙂 x y <|endoftext|> z  "),
    (7, "word " * 3000 + "\n" + "long" * 500 + " " * 900 + "end"),
    (None, "no id"),
    (8, "x" * 5000),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "a clash", j) for j, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")


@pytest.fixture(scope="module")
def byte_bpe():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def rank_bpe():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_equal_library(name):
    encoder = piece_encoder(P.path(name))
    rng = random.Random(5)
    alphabet = [*"abé'sTLlRe1٣ \n\t \x1c\x85İΣς.,%#中é<|>", "<|endoftext|>", "'re", " \n", "  ", "I'LL", "é", " ́"]
    texts = [t or "" for _, t in TEXTS] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(3000)]
    for text, ids in zip(texts, encoder.encode_many(pa.array(texts)), strict=True):
        assert ids.tobytes() == encoder.whole(text), repr(text)
    assert encoder.encode_many(pa.array([], pa.string())) == [] and [len(x) for x in encoder.encode_many(pa.array(["", "a", ""]).slice(1))] == [1, 0]


def test_cache_generations():
    asked = []
    cache = Generations(lambda names: asked.extend(names) or [x.encode() for x in names], 3)
    assert cache(["a", "b", "a"]) == [b"a", b"b", b"a"] and asked == ["a", "b"]
    assert cache(["c", "d"]) == [b"c", b"d"]
    assert cache(["a", "e"]) == [b"a", b"e"] and asked == ["a", "b", "c", "d", "e"]  # a moves to the young generation
    cache(["f", "g"])
    assert cache(["a", "b"]) == [b"a", b"b"] and asked[5:] == ["f", "g", "b"]  # b had gone
    assert len(cache.young) + len(cache.old) <= 8


def test_token_files(spark, docs, byte_bpe):
    path = scratch_path(spark, "test")
    token_files.write_token_files(docs, path, P.path("byte_bpe_50k.json"), 2)
    rows = token_files.digest_token_files(spark, path).collect()
    assert len(rows) == len(TEXTS)
    start = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == start
        start += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda i: (i is not None, i))
    want = sorted((i is not None, i or 0, zlib.crc32(np.array(byte_bpe.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes())) for i, t in TEXTS)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["ids_crc32"]) for r in rows) == want
    found = token_files.read_token_files(spark, path).where("doc_id = 7")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in found._jdf.queryExecution().executedPlan().toString() and found.count() == 1


def test_token_files_bloom(spark):
    """Rows that the scan hands on: a row index entry's for an id that is there, none for one that only the Bloom filter can rule out."""
    from pyarrow import fs, orc

    from tessel.metrics import plan_metrics, total

    path = scratch_path(spark, "test")
    rows = spark.range(0, 40_000, 2, 1).selectExpr("id as doc_id", "concat('text ', id) as text")
    token_files.write_token_files(rows, path, P.path("byte_bpe_50k.json"), 2)
    parts = [f.path for f in fs.LocalFileSystem().get_file_info(fs.FileSelector(path.removeprefix("file://"))) if f.path.endswith(".orc")]
    meta = [orc.ORCFile(p) for p in parts]
    assert sum(m.nrows for m in meta) == 20_000 and all(m.row_index_stride == 1000 for m in meta)

    def scanned(doc_id):
        found = token_files.read_token_files(spark, path).where(f"doc_id = {doc_id}")
        n = len(found.collect())
        return n, total(plan_metrics(found), "Scan orc", "numOutputRows")

    there = [scanned(k) for k in (3000, 20_000, 39_998)]
    assert all(n == 1 and 1 <= read <= 2000 for n, read in there), there
    absent = [scanned(k) for k in range(3001, 3041, 2)]
    assert all(n == 0 for n, _ in absent) and sum(read == 0 for _, read in absent) >= 17, absent
    assert scanned(10**9) == (0, 0)


def codec_truth(enc, text):
    ids = enc.encode_ordinary(text)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("chunk,overlap", [(65_536, 1024), (700, 64), (100, 40)])
def test_codec(docs, rank_bpe, chunk, overlap):
    rows = bpe_codec.encode_decode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, chunk, overlap).collect()
    want = sorted((str(i), *codec_truth(rank_bpe, t or "")) for i, t in TEXTS)
    assert sorted((str(r[0]), *r[1:]) for r in rows) == want


@pytest.mark.parametrize("name,chunk,overlap", [("byte_bpe_50k.json", 65_536, 1024), ("byte_bpe_50k.json", 300, 60), ("piece_bpe_32k.model", 300, 80)])
def test_counts(docs, byte_bpe, name, chunk, overlap):
    rows = token_counts.token_counts(docs, P.path(name), 512, chunk, overlap).collect()
    if name.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=P.path(name))
        count = lambda t: len(sp.encode(t))
    else:
        count = lambda t: len(byte_bpe.encode(t, add_special_tokens=False).ids)
    want = sorted((str(i), len((t or "").encode()), count(t or ""), count(t or "") > 512) for i, t in TEXTS)
    assert sorted((str(r[0]), *r[1:]) for r in rows) == want


def test_widening(byte_bpe):
    counter = token_counts.library_counter(P.path("byte_bpe_50k.json"))
    for text in ("ab cd " * 500, "x" * 3000, "a " + "y" * 700 + " b" * 200, " " * 2000 + "z"):
        assert token_counts.count_by_widening(counter, text, 100, 5) == len(byte_bpe.encode(text).ids)


def test_packing(spark, docs):
    word = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = packing.pack(docs, P.path("word_bpe_49k.json"), 1).collect()
    ids = {}
    for i, t in TEXTS:
        ids.setdefault(i, []).append(np.array(word.encode(t or "", add_special_tokens=False).ids + [1], "<u4"))
    assert sum(r["length"] for r in rows) == sum(len(x) for own in ids.values() for x in own)
    sequences = {}
    for r in rows:
        own = [x for x in ids[r["doc_id"]] if len(x) == r["doc_tokens"]]
        assert any(zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in own)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 2048 or at & at - 1 == 0


def test_assign_balances():
    rng = random.Random(1)
    lengths = [rng.randrange(1, 5000) for _ in range(500)]
    pieces, sizes = packing.assign(lengths, 2048)
    filled, covered = [0] * len(sizes), [0] * len(lengths)
    for k, _, n, s in pieces:
        filled[s] += n
        covered[k] += n
    assert filled == sizes and covered == lengths and sum(s != 2048 for s in sizes) <= 11
    assert packing.assign([], 2048) == ([], []) and packing.assign([2048, 4096], 2048)[1] == [2048] * 3
    # first come the longest, each to the cheapest sequence
    first = [p for p in packing.assign([100, 100, 900, 900, 48], 1024)[0]]
    assert {s for k, _, _, s in first if k in (2, 3)} == {0, 1}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    path = scratch_path(spark, "test")
    token_files.write_token_files(none, path, P.path("byte_bpe_50k.json"), 2)
    assert token_files.digest_token_files(spark, path).count() == 0
    assert bpe_codec.encode_decode(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    assert token_counts.token_counts(none, P.path("byte_bpe_50k.json")).count() == 0
    assert packing.pack(none, P.path("word_bpe_49k.json"), 1).count() == 0


def test_stitches_need_a_common_boundary(spark):
    edges = spark.createDataFrame(
        [(1, 0, False, [], [], [10, 12], [4, 5]), (1, 1, True, [11, 12, 15], [1, 2, 3], [], []), (2, 0, False, [], [], [10], [1]), (2, 1, True, [11], [1], [], [])],
        "uid long, i int, last boolean, head_at array<long>, head_n array<long>, tail_at array<long>, tail_n array<long>",
    )
    assert sorted(map(tuple, chunks.stitches(edges).where(F.col("uid") > 0).collect())) == [(1, 0, 12, 5, 2), (2, 0, None, None, None)]
