"""Encoding against the tokenizers library, exact round trips, and the ORC files."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from odd_documents import ODD, SF_SMALL, docs_of
from strideframe.llm import bpe, token_files
from strideframe.session import scratch_dir

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(BYTE)
VOCABULARY = bpe.Vocabulary(BYTE)
MORE = ["don't I'LL we've", " <|endoftext|> a<|endoftext|>", "a  b   c \n d\n\n", "\tx\t y", "1234567 ٣٤", "日本語 text"]


def expected(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab theé\n\t 　'sS12.,!<|endoftext|>\U0001f642日", max_size=60))
def test_encode_equals_the_library(text):
    ids, decoded = expected(text)
    got = VOCABULARY.encode([text])[0]
    assert np.frombuffer(got, "<u4").tolist() == ids
    assert VOCABULARY.decode(got).decode() == decoded == text


def test_every_character_is_classed_as_the_library_does():
    texts = []
    for first in range(0, 0x110000, 500):
        texts.append(" ".join(f"{chr(c)}'sa1" for c in range(first, min(first + 500, 0x110000)) if not 0xD800 <= c < 0xE000) or "-")
    got = bpe.Vocabulary(BYTE)
    for i in range(0, len(texts), 200):
        part = texts[i:i + 200]
        want = [np.array(e.ids, "<u4").tobytes() for e in LIBRARY.encode_batch_fast(part, add_special_tokens=False)]
        assert got.encode(part) == want
        got.forget()


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "的一是不了人我在有他这为之大来以个中上们"])
def test_one_very_long_word_takes_memory_in_proportion(letters):
    import tracemalloc

    rng = np.random.default_rng(5)
    peaks = []
    for size in (25_000, 100_000):
        text = "".join(np.array(list(letters))[rng.integers(0, len(letters), size)])
        voc = bpe.Vocabulary(BYTE)
        tracemalloc.start()
        got = voc.encode([text])[0]
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert np.frombuffer(got, "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
        assert voc.decode(got).decode() == text
    assert peaks[1] < 6 * peaks[0] and peaks[1] < 100 << 20


def test_shared_prefixes_are_worked_out_once():
    words = [b"standing", b"stand", b"standings", b"stands", b"sta"]
    asked = []
    voc = bpe.Vocabulary(BYTE)
    real = voc.id_of

    class Counting(dict):
        def get(self, key, default=None):
            asked.append(key)
            return real.get(key, default)

    voc.id_of = Counting()
    voc.encode_words(words)
    assert asked.count(b"s") <= 2 and len(asked) < 60


def test_query_equals_the_library(spark):
    texts = ODD + MORE
    got = {r["doc_id"]: r for r in bpe.token_digests(docs_of(spark, texts), BYTE).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids, decoded = expected(t)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.token_digests(docs_of(spark, []), BYTE).count() == 0


def test_encode_keeps_columns_and_decodes(spark):
    r = bpe.encode(docs_of(spark, ["a b", "a b", None], ids=[1, 1, None]), BYTE).collect()
    assert sorted((x["payload"]["doc_id"] is None, x["decoded"]) for x in r) == [(False, "a b"), (False, "a b"), (True, "")]


def test_words_met_lately_are_kept(monkeypatch):
    monkeypatch.setattr(token_files, "MEMORY", 8)
    encoder, library = token_files.Encoder(WORD), Tokenizer.from_file(WORD)
    texts = [f"the word{i} of day{i}, the end" for i in range(60)]
    for i in range(0, 60, 3):
        part = texts[i:i + 3]
        want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in part]
        assert encoder.encode([t.encode() for t in part]) == want
        assert len(encoder.known) + len(encoder.before) < 40
    assert b"the" in encoder.known


def test_a_hot_doc_id_is_split(spark, monkeypatch):
    """Rows of one id, or of none, that hold most of the table come from several tasks."""
    seen = []
    docs = docs_of(spark, [f"text {i}" for i in range(4000)], ids=[None] * 2000 + [7] * 2000).select("doc_id", "text")
    cls = type(docs)
    real = cls.mapInArrow
    monkeypatch.setattr(cls, "mapInArrow", lambda self, *a, **k: seen.append(self) or real(self, *a, **k))
    folder = scratch_dir(spark, "test-hot-id")
    token_files.write(docs, folder, WORD)
    most = seen[0].groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 2000
    rows = sorted((r["start"], r["n_tokens"]) for r in token_files.positions(spark, folder).collect())
    assert len(rows) == 4000 and all(a + n == b for (a, n), (b, _) in zip(rows, rows[1:]))


def test_files_hold_the_librarys_ids_in_order(spark):
    library = Tokenizer.from_file(WORD)
    texts = ODD + MORE
    ids = [None, 5, 5, *range(100, 100 + len(texts) - 3)]
    folder = scratch_dir(spark, "test-tokens")
    token_files.write(docs_of(spark, texts, ids).select("doc_id", "text"), folder, WORD)
    exp, pool = {}, {}
    for i, t in zip(ids, texts):
        pool.setdefault(i, []).append(library.encode(t or "", add_special_tokens=False).ids + [2])
    rows = {}
    for r in token_files.positions(spark, folder).collect():
        rows.setdefault(r["doc_id"], []).append(r)
    at = 0
    for i in sorted(pool, key=lambda x: (x is not None, x)):
        for r in sorted(rows[i], key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["n_tokens"]
        want = sorted((len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in pool[i])
        assert sorted((r["n_tokens"], r["ids_crc32"]) for r in rows[i]) == want
    one = token_files.read(spark, folder).filter(F.col("doc_id") == 104).collect()
    assert len(one) == 1
    plan = token_files.read(spark, folder).filter(F.col("doc_id") == 104)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,104)]" in plan


def test_files_have_stripes_indexes_and_bloom_filters(spark):
    import pyarrow.orc as orc
    from glob import glob

    folder = scratch_dir(spark, "test-orc").replace("file:", "")
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    token_files.write(docs, folder, WORD)
    files = [orc.ORCFile(f) for f in sorted(glob(f"{folder}/*.orc"))]
    assert sum(f.nrows for f in files) == 200 and all(f.nstripes >= 1 and f.row_index_stride == 1000 for f in files if f.nrows)
    ids = [x for f in files for x in f.read(["doc_id"]).column(0).to_pylist()]
    assert ids == sorted(ids)


def test_empty_table(spark):
    folder = scratch_dir(spark, "test-empty")
    token_files.write(docs_of(spark, []).select("doc_id", "text"), folder, WORD)
    with pytest.raises(Exception):
        spark.read.orc(folder).filter("no_such_column = 1").count()
    assert token_files.positions(spark, folder).count() == 0
