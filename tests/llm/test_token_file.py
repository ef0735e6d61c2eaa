"""Bit-packed token files: widths, random access, documents over several shards, odd rows."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from codequarry.llm import token_file
from codequarry.llm.queries import vocabulary
from codequarry.session import scratch_path

JSON = vocabulary("byte_bpe_50k.json")


@pytest.mark.parametrize("bits", [1, 7, 15, 16, 17, 31, 32])
@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 9000])
def test_packing_and_random_access(bits, n):
    ids = np.random.default_rng(n + bits).integers(0, 1 << bits, n).astype(np.uint32)
    words = token_file.packed(ids, bits)
    assert len(words) == -(-n // 64) * bits and (token_file.unpacked(words, n, bits) == ids).all()
    # bit k of id i stands at bit i * bits + k of the words
    flat = np.unpackbits(words.astype("<u8").view(np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
    assert (flat.astype(np.uint64) @ (1 << np.arange(bits, dtype=np.uint64)) == ids).all()
    shard = token_file.Shard(token_file.shard_bytes(ids, np.zeros(0, token_file._TABLE), bits, 3, 4, False) + b"\n")
    assert (shard.bits, shard.part, shard.seq, shard.n_ids) == (bits, 3, 4, n)
    for a, b in [(0, n), (n // 2, n // 2 + 1), (n // 3, n), (n, n + 5), (4090, 4100)]:
        assert (shard.ids(a, b) == ids[a:b]).all()


def test_width():
    assert token_file.width(open(JSON, encoding="utf-8").read()) == 16
    assert token_file.width('{"model": {"vocab": {"a": 0, "b": 4}}, "added_tokens": [{"id": 9, "content": "x"}]}') == 4
    with pytest.raises(ValueError):
        token_file.Shard(b"something else" * 9)


def brute_force(rows, end_id=0):
    whole, out, start = Tokenizer.from_file(JSON), [], 0
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, len((r[1] or "").encode())))
    ids = [(i, np.array([*whole.encode(t or "", add_special_tokens=False).ids, end_id], "<u4")) for i, t in rows]
    for i, x in ids:
        out.append((i, start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    return out


@pytest.mark.parametrize("shard_ids", [1 << 21, 64, 7])
def test_files(spark, shard_ids):
    pick = random.Random(3)
    texts = [None, "", "a", "x" * 700, "漢字 🙂 <|endoftext|> é", " ".join(pick.choices("ab cd ef".split(), k=500))]
    rows = [(pick.choice([-5, 0, 7, 10**12]) + i, pick.choice(texts), "s") for i in range(40)] + [(None, "no id", "s"), (99, "twice", "s"), (99, "twice", "s"), (99, "thrice or more", "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string").repartition(5)
    path = scratch_path(spark, "token-test")
    token_file.write(docs, JSON, path, shard_ids=shard_ids)
    got = sorted(map(tuple, token_file.digests(spark, path).collect()), key=lambda r: r[1])
    assert got == brute_force([r[:2] for r in rows])
    index = spark.read.parquet(f"{path}/index").orderBy("start").collect()
    assert all(r.n_ids <= shard_ids for r in index) and index[-1].start + index[-1].n_ids == got[-1][1] + got[-1][2]
    # a file by itself: its ids at their places, read without Spark
    last = token_file.Shard(open(index[-1].path.removeprefix("file:"), "rb").read())
    assert last.ids(last.n_ids - 1)[0] == 0


def test_long_text_and_empty_table(spark):
    long = " ".join(random.Random(1).choices("some words of a long text, again".split(), k=250_000))
    path = scratch_path(spark, "token-test")
    token_file.write(spark.createDataFrame([(1, long), (2, None)], "doc_id bigint, text string"), JSON, path, shard_ids=100_000)
    assert sorted(map(tuple, token_file.digests(spark, path).collect())) == brute_force([(1, long), (2, None)])
    path = scratch_path(spark, "token-test")
    token_file.write(spark.createDataFrame([], "doc_id bigint, text string"), JSON, path)
    assert token_file.digests(spark, path).count() == 0


def test_a_reader_unpacks_only_the_spans_it_wants(monkeypatch):
    n, block = 40 * token_file.BLOCK, token_file.BLOCK
    ids = np.arange(n, dtype=np.uint32) % 50_000
    docs = np.array([(1, 1, 0, 2, 0), (2, 1, 1, 0, 10), (3, 1, 2, 0, 20 * block), (4, 1, 3, 0, n - 10)], token_file._TABLE)
    s, asked, real = token_file.Shard(token_file.shard_bytes(ids, docs, 16, 0, 0, True)), [], token_file.unpacked
    monkeypatch.setattr(token_file, "unpacked", lambda words, k, bits: asked.append(k) or real(words, k, bits))
    assert s.spans(True) == [(1, 3)] and s.spans(False) == [(0, 1), (3, 4)]
    assert s.ids(0, 10).tolist() == ids[:10].tolist() and s.ids(n - 10, n).tolist() == ids[-10:].tolist()
    assert sum(asked) == 2 * block
    alone = token_file.Shard(token_file.shard_bytes(ids, docs[:1], 16, 0, 0, True))
    assert alone.spans(True) == [] and alone.spans(False) == [(0, 1)]


def test_headers_are_listed_without_python(spark, tmp_path, monkeypatch):
    plans = {}
    kept = token_file.written
    monkeypatch.setattr(token_file, "written", lambda df, name, *a: (plans.update({name: df._jdf.queryExecution().toString()}), kept(df, name, *a))[1])
    rows = [(i, "word " * i) for i in range(300)]
    token_file.write(spark.createDataFrame(rows, "doc_id bigint, text string"), JSON, str(tmp_path), shard_ids=128)
    assert "MapInArrow" not in plans["token-heads"]
    listed = spark.read.parquet(f"{tmp_path}/index").orderBy("start").collect()
    assert len(listed) > 256 and {r["n_ids"] for r in listed[:-8]} <= set(range(1, 129))
    assert [r["start"] for r in listed] == [0, *[r["start"] + r["n_ids"] for r in listed[:-1]]]
