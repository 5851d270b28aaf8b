"""Token files: exact round trips against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import token_io

TEXTS = ["", " ", "a", "Hello  world\n\n it's 12½ x² été ", "日本語 <|endoftext|> ok", "\x1c\x85 a b", "don't  they'll\t", "x" * 500, "12345 678", "_a _ __b", "ª º ×÷", "é ٠"]


def library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def corpus():
    rng = random.Random(4)
    syll = ["th", "er", " ", " ", "\n", "é", "'s", "42", ".", "—", "ing", "tion", "  ", "_", "ß"]
    return TEXTS + ["".join(rng.choice(syll) for _ in range(rng.randrange(0, 300))) for _ in range(80)] + ["the end of the line " * 4000]


def test_pieces_equal_whole_texts():
    lib = library()
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        enc = token_io.Encoder(f.read())
    for t in corpus():
        assert np.frombuffer(enc.encode_bytes(t), dtype="<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t[:80]


@pytest.mark.parametrize("seed", range(4))
def test_coder_round_trip(seed):
    rng = np.random.default_rng(seed)
    blocks = [rng.integers(0, [2, 300, 50257, 131072][k % 4], rng.integers(0, 700)).astype("<u4") for k in range(40)]
    blocks += [np.zeros(0, "<u4"), np.full(600, 50256, "<u4"), np.tile(np.arange(50, dtype="<u4"), 20), np.array([131071], "<u4")]
    payloads = token_io.compress(blocks)
    sums = [zlib.crc32(b.tobytes()) for b in blocks]
    back = token_io.decompress(payloads, [len(b) for b in blocks], sums)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, back, strict=True))
    # blocks are independent, whatever is coded beside them
    assert token_io.compress(blocks[3:5]) == payloads[3:5]
    assert len(payloads[-2]) < 400 and len(payloads[-3]) < 100


def test_damage_is_found():
    ids = np.arange(1000, dtype="<u4") % 77
    (payload,) = token_io.compress([ids])
    bad = bytearray(payload)
    bad[len(bad) // 2] ^= 255
    with pytest.raises(ValueError):
        token_io.decompress([bytes(bad)], [1000], [zlib.crc32(ids.tobytes())])


def test_query(spark, monkeypatch):
    lib = library()
    rows = [(1000 - i, t, "clash", 1) for i, t in enumerate(corpus())] + [(None, "no id", None, 2), (1000, None, None, 3)]
    d = spark.createDataFrame(rows, "doc_id long, text string, shard string, place int")
    got = sorted(token_io.round_trip(d).collect(), key=lambda r: r.start)
    want = {}
    for i, t, *_ in rows:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    assert len(got) == len(rows)
    place = 0
    for r in got:
        assert r.start == place and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        place += r.n_tokens
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    assert token_io.round_trip(d.limit(0)).count() == 0


def test_added_tokens_equal_the_unmodified_library(spark):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        enc = token_io.Encoder(f.read(), added_tokens=True)
    texts = [*corpus(), "a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x  <|endoftext", " é<|endoftext|>\n\n日"]
    for t in texts:
        assert np.frombuffer(enc.encode_bytes(t), dtype="<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t[:80]
    assert np.frombuffer(enc.encode_bytes("a <|endoftext|> b"), dtype="<u4").tolist() == [64, 220, 50256, 275]


def test_registered_query_keeps_added_tokens(spark, tmp_path):
    from tessera.llm.queries import QUERIES

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["plain", "a <|endoftext|> b", "after it"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in QUERIES["op5_token_ids"](spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 2], dtype="<u4")
        assert got[i] == (len(ids), zlib.crc32(ids.tobytes()))


def test_coder_beats_zstd():
    """Ids of words drawn by Zipf's law, in blocks: fewer bits than zstd over 16-bit ids."""
    import zstandard

    rng = np.random.default_rng(9)
    words = [rng.integers(0, 50257, rng.integers(1, 5)) for _ in range(3000)]
    chance = 1 / np.arange(1, 3001)
    drawn = rng.choice(3000, 9000, p=chance / chance.sum())
    ids = np.concatenate([words[w] for w in drawn]).astype("<u4")
    blocks = [ids[k : k + token_io.BLOCK] for k in range(0, len(ids), token_io.BLOCK)]
    payloads = token_io.compress(blocks)
    plain = sum(len(zstandard.ZstdCompressor(level=3).compress(b.astype("<u2").tobytes())) for b in blocks)
    assert sum(map(len, payloads)) < plain
    back = token_io.decompress(payloads, [len(b) for b in blocks])
    assert all(np.array_equal(a, b) for a, b in zip(blocks, back, strict=True))


def test_tables_of_the_mixer_and_block_limit():
    assert token_io._SQUASH[2047] == token_io._ONE // 2
    assert np.all(np.diff(token_io._STRETCH) >= 0) and np.all(np.diff(token_io._SQUASH) >= 0)
    assert token_io.compress([]) == [] and token_io.decompress([], []) == []
    with pytest.raises(ValueError):
        token_io.compress([np.zeros(1 << 14, dtype="<u4")])


def test_both_coders_are_one(spark):
    """The JVM's coder, which writes and reads the files, against the one in numpy."""
    rng = np.random.default_rng(3)
    blocks = [rng.integers(0, [2, 300, 50257, 131072][k % 4], rng.integers(0, 700)).astype("<u4") for k in range(40)]
    blocks += [np.minimum(rng.zipf(1.2, 4096), 131071).astype("<u4") for _ in range(8)]
    blocks += [np.zeros(0, "<u4"), np.full(600, 50256, "<u4"), np.tile(np.arange(50, dtype="<u4"), 20), np.arange(16383, dtype="<u4")]
    token_io.coder_functions(spark)
    d = spark.createDataFrame([(k, b.tobytes(), len(b)) for k, b in enumerate(blocks)], "k int, ids binary, n int")
    coded = d.selectExpr("k", "ids", "n", "token_encode(ids) as payload").collect()
    payloads = [bytes(r.payload) for r in sorted(coded, key=lambda r: r.k)]
    assert payloads == token_io.compress(blocks)
    back = spark.createDataFrame(coded).selectExpr("ids", "token_decode(payload, cast(n as int)) as back").collect()
    assert all(r.ids == r.back for r in back)


def test_damaged_file_is_refused(spark, tmp_path):
    d = spark.createDataFrame([(k, "some words of text " * 50) for k in range(20)], "doc_id long, text string")
    token_io.write_tokens(d, f"{tmp_path}/tokens")
    files = spark.read.parquet(f"{tmp_path}/tokens")
    assert token_io.read_tokens(files).count() == 20
    with pytest.raises(Exception, match="damaged"):
        token_io.read_tokens(files.selectExpr("shard", "block", "n_ids", "crc32 + 1 as crc32", "payload", "doc_ids", "doc_sizes")).collect()


def test_files_are_not_coded_in_python(spark, monkeypatch):
    """A GB is some 400 million ids, which numpy takes four budgets to code and decode."""
    rows = token_io._write_rows(type("", (), {"value": open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()}), 2, True)
    monkeypatch.setattr(token_io, "compress", None)
    monkeypatch.setattr(token_io.TaskContext, "get", lambda: type("", (), {"partitionId": lambda: 0}))
    import pyarrow as pa

    (batch,) = rows(iter([pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["some words"]})]))
    assert batch.column("n_ids").to_pylist() == [3]


def test_small_memory_of_pieces(monkeypatch):
    monkeypatch.setattr(token_io, "CACHE", 6)
    lib = library()
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        enc = token_io.Encoder(f.read())
    for t in ["one two three four five one two six", "it's  été_1 ÷\n\n x", *TEXTS, "one two three"]:
        assert np.frombuffer(enc.encode_bytes(t), dtype="<u4").tolist() == lib.encode(t, add_special_tokens=False).ids
        assert len(enc._known) + len(enc._older) <= 6
