"""Alignment, fill-in-middle and the quality classifier against plain versions of their definitions."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from odd_documents import ODD, SF_SMALL, docs_of
from strideframe.llm import alignment, middles, quality

BYTE, PIECE = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SF = SF_SMALL.replace("0.001", "0.01")


# ---- alignment -------------------------------------------------------------

@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(BYTE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECE)


def plain_alignment(texts, libraries):
    a_lib, b_lib = libraries
    letter = alignment.byte_letters()
    a_bytes = {i: bytes(letter[c] for c in t) for t, i in a_lib.get_vocab().items() if t != "<|endoftext|>"}

    def b_bytes(i):
        p = b_lib.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode()

    docs, held = [], collections.Counter()
    for text in texts:
        want = (" " + (text or "")).encode()
        a = a_lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        if not text or b"".join(a_bytes[i] for i in a) != want or b"".join(map(b_bytes, b)) != want:
            docs.append(None)
            continue
        a_end, b_end = np.cumsum([len(a_bytes[i]) for i in a]).tolist(), np.cumsum([len(b_bytes(i)) for i in b]).tolist()
        groups, links, i, j = [], [], 0, 0
        for end in sorted({*a_end} & {*b_end}):
            x = [k for k in range(i, len(a)) if a_end[k] <= end] if len(a) < 2000 else list(range(i, a_end.index(end) + 1))
            y = [k for k in range(j, len(b)) if b_end[k] <= end] if len(b) < 2000 else list(range(j, b_end.index(end) + 1))
            i, j = x[-1] + 1, y[-1] + 1
            groups.append(",".join(str(a[k]) for k in x) + "|" + ",".join(str(b[k]) for k in y))
            links += [(a[u], b[v]) for u in x for v in y
                      if a_end[u] - len(a_bytes[a[u]]) < b_end[v] and b_end[v] - len(b_bytes(b[v])) < a_end[u]]
        docs.append((len(a), len(b), groups, links))
        held.update(set(links))
    most = collections.Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    return [(0, 0, 0, 0, 0, 0, "") if d is None else
            (d[0], d[1], len(d[2]), len(d[3]), sum(held[x] == most[x[0]] for x in d[3]), sum(held[x] for x in d[3]),
             hashlib.sha256(";".join(d[2]).encode()).hexdigest()) for d in docs]


def test_alignment_equals_the_definition(spark, libraries, monkeypatch):
    r = random.Random(3)
    bits = ["a", "the ", " ", "  ", "\n", "é", "日本", "▁", "'s", " '", "12", "　", "\x85", "ǅ", "ab cd", "\t", "<|endoftext|>",
            "</s>", "<0x0A>", "\U000323b0", "\x1c", "\xa0", "​"]
    odd = [t if t is None or len(t) < 9000 else t[:9000] for t in ODD]
    texts = odd + ["".join(r.choices(bits, k=r.randrange(14))) for _ in range(600)] + ["日本語" * 900, " " * 900, "one hot row"] \
        + ["one hot row"] * 200
    monkeypatch.setattr(alignment, "BLOCK_CHARACTERS", 2000)
    got = {x["doc_id"]: tuple(x)[1:] for x in alignment.digests(docs_of(spark, texts), BYTE, PIECE).collect()}
    want = plain_alignment(texts, libraries)
    assert len(got) == len(texts)
    assert [got[i] for i in range(len(texts))] == want


def test_alignment_of_given_documents(spark, libraries):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.digests(docs, BYTE, PIECE).collect()}
    assert [got[i] for i in texts] == plain_alignment(list(texts.values()), libraries)


def test_windows_are_aligned_once_and_words_forgotten(monkeypatch):
    pair = alignment.Pair(BYTE, PIECE)
    calls = []
    real = alignment.align
    monkeypatch.setattr(alignment, "align", lambda *x: calls.extend(x[3]) or real(*x))
    monkeypatch.setattr(alignment, "MEMORY", 3)
    block = alignment.Block(pair)
    first = block.add(["stand by me stand by me", "stand by"])
    assert len(calls) == 3 and block.groups.tolist() == [1, 1, 1]
    assert block.add(["stand by me stand by me", "me"])[0] == first[0] and len(calls) == 3
    assert block.docs[:3].tolist().count(4) == 0 and sorted(block.docs[:3].tolist()) == [3, 3, 3]
    block.add(["other words follow here"])
    assert "stand" not in pair.a_of or len(pair.a_of) > 3


@pytest.mark.parametrize("numbers", [[], [0], [5, 255, 0], [256, 70_000, 1 << 24], [1 << 40]])
def test_packed_numbers_come_back(numbers):
    assert alignment.unpacked(alignment.packed(np.array(numbers, np.int64))).tolist() == numbers


def test_alignment_keeps_groups_columns_and_stands_empty_tables(spark):
    got = alignment.aligned(docs_of(spark, ["ab cd", "ab cd", None], ids=[1, 1, None]), BYTE, PIECE).collect()
    assert len(got) == 3 and {"payload", "groups", "count_sum"} <= set(got[0].asDict())
    both = [r for r in got if r["payload"]["doc_id"] == 1]
    assert both[0]["groups"] == both[1]["groups"] != "" and both[0]["count_sum"] == 2 * both[0]["n_links"]
    assert both[0]["payload"]["rk"] == 7
    assert alignment.digests(docs_of(spark, []), BYTE, PIECE).count() == 0


# ---- fill-in-middle ----------------------------------------------------------

def plain_rewrite(text, key):
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{key}".encode()).hexdigest()
    h1, h2, _, h4 = [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(lines)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(lines[:first]), "".join(lines[first:second]), "".join(lines[second:])
    if h4 % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_rewriting_equals_the_definition_and_inverts():
    r = random.Random(1)
    for k in range(4000):
        text = "".join(r.choices("a\né\r<SPM>日 ", k=r.randrange(30))) if k % 200 else "line é\n" * r.randrange(40_000)
        got, want = middles.rewrite(text.encode(), str(k)), plain_rewrite(text, str(k))
        assert (*got[:4], got[4].decode()) == want
        assert middles.restored(got[4], got[1]) == text.encode()


@pytest.mark.parametrize("sizes", [(0, 0), (0, 5), (5, 0), (3, 4), (70_000, 150_001), (200_000, 1)])
def test_rotation_exchanges_blocks_in_place(sizes):
    left, right = [bytes(np.random.default_rng(n).integers(0, 256, n, np.uint8)) for n in sizes]
    buffer = bytearray(b"<" + left + right + b">")
    middles.rotate(buffer, 1, 1 + len(left), 1 + len(left) + len(right))
    assert bytes(buffer) == b"<" + right + left + b">"


def test_round_trips_of_odd_rows(spark):
    texts = ODD + ["a<P>b", "x\ny\nz", "\nz", "x\n"]
    ids = [None, 5, 5, *range(100, 100 + len(texts) - 3)]
    want = collections.Counter()
    for i, t in zip(ids, texts):
        n, form, before, between, out = plain_rewrite(t or "", "" if i is None else str(i))
        want[i, n, form, before, between, *[hashlib.sha256(x.encode()).hexdigest() for x in (out, t or "")]] += 1
    got = collections.Counter(tuple(r) for r in middles.round_trips(docs_of(spark, texts, ids)).collect())
    assert got == want
    assert middles.round_trips(docs_of(spark, [])).count() == 0


def test_round_trips_equal_the_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.sql(middles.SQL).fetchall(), key=lambda x: x[0])
    assert sorted(tuple(r) for r in middles.round_trips(docs).collect()) == want
    assert {r[2] for r in want} == {"psm", "spm"} and all(r[-1] for r in want)


def test_rate_and_columns(spark):
    rows = middles.transform(docs_of(spark, ["a\nb\n"] * 300), rate=40).collect()
    plain = sum(r["form"] == "plain" for r in rows)
    assert 120 < plain < 240 and all(r["output"] == "a\nb\n" for r in rows if r["form"] == "plain")
    assert rows[0]["payload"]["source"] == "s" and rows[0]["payload"]["payload"] == 7


# ---- quality -----------------------------------------------------------------

def plain_vector(text):
    """Place -> value, written directly."""
    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x00-\x20\x7f-\xff]+", text.encode())
    mask = (1 << 64) - 1

    def number(word):
        return sum((b + 1) * pow(0x100000001B3, k, 1 << 64) for k, b in enumerate(word.lower())) & mask

    numbers = [number(w) for w in words]
    numbers = [0x51ED270B if k and h == numbers[k - 1] else h for k, h in enumerate(numbers)]
    grams = numbers + [(x * 0x100000001B3 + y) & mask for x, y in zip(numbers, numbers[1:])]
    count = collections.Counter((g * 0x9E3779B97F4A7C15 & mask) >> 64 - quality.BITS for g in grams)
    value = {k: math.log1p(n) for k, n in count.items()}
    length = math.sqrt(sum(v * v for v in value.values()))
    return {k: v / length for k, v in value.items()}


class PlainLearner:
    def __init__(self):
        self.z, self.n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(self, k):
        if abs(self.z[k]) <= quality.L1:
            return 0.0
        return -(self.z[k] - math.copysign(quality.L1, self.z[k])) / ((quality.BETA + math.sqrt(self.n[k])) / quality.ALPHA + quality.L2)

    def score(self, x):
        return 1 / (1 + math.exp(-sum(v * self.weight(k) for k, v in [*x.items(), (quality.SIZE, 1.0)])))

    def update(self, x, label, weight):
        p = self.score(x)
        for k, v in [*x.items(), (quality.SIZE, 1.0)]:
            g, w = weight * (p - label) * v, self.weight(k)
            self.z[k] += g - (math.sqrt(self.n[k] + g * g) - math.sqrt(self.n[k])) / quality.ALPHA * w
            self.n[k] += g * g


QUALITY_TEXTS = ["The cat and the dog.", "junk junk junk junk", "A a A a", "über Straße!! !! x", "", " \n ", "12 34 | 56 | 78", "\x00\x7f a\x7fb"]


def test_vectors_and_updates_equal_the_definition():
    raw = [t.encode() for t in QUALITY_TEXTS]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in raw])))
    begin, place, value = quality.vectors(np.frombuffer(b"".join(raw), np.uint8), offsets)
    learner, plain = quality.Learner(), PlainLearner()
    for k, text in enumerate(QUALITY_TEXTS * 3):
        i = k % len(QUALITY_TEXTS)
        p, v = place[begin[i]:begin[i + 1]], value[begin[i]:begin[i + 1]]
        want = plain_vector(text)
        assert dict(zip(p.tolist(), v.tolist())) == pytest.approx(want)
        learner.update(p, v, k % 2, 1.0 + k % 3)
        plain.update(want, k % 2, 1.0 + k % 3)
    weights = learner.weights()
    got = quality.scores(np.frombuffer(b"".join(raw), np.uint8), offsets, weights)
    assert got.tolist() == pytest.approx([plain.score(plain_vector(t)) for t in QUALITY_TEXTS])


def test_training_reads_only_what_it_may(spark):
    """The weights equal those of the plain learner on the sampled rows, in the order stated."""
    texts = [f"good text number {i} is fine" if i % 3 else f"bad### {i}### !!" for i in range(90)] + ["copy of one"] * 40
    labels = [(i, int(i % 3 > 0), 0) for i in range(90)] + [(i, 1, 0) for i in range(90, 130)] + [(3, 0, 0), (None, 1, 0), (7, None, 0), (5000, 1, 0)]
    docs = docs_of(spark, texts)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    picked = quality.sample(docs, table).collect()
    allowed = {(y, texts[i]) for i, y, _ in labels if i is not None and i < 130 and y is not None and zlib.crc32(str(i).encode()) % 3 != 1}
    assert {(r["label"], r["text"]) for r in picked} == allowed and len(picked) == len(allowed)
    ordered = spark.createDataFrame([tuple(r) for r in picked], "label int, key long, text string, weight double").select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(quality.EPOCHS))).alias("epoch")).withColumn("turn", F.xxhash64("key", "epoch"))
    plain = PlainLearner()
    for r in sorted(ordered.collect(), key=lambda r: (r["epoch"], r["turn"], r["label"])):
        plain.update(plain_vector(r["text"]), r["label"], r["weight"])
    want = np.array([plain.weight(k) for k in range(quality.SIZE + 1)])
    assert np.abs(quality.train(docs, table) - want).max() < 1e-5


def test_sample_is_bounded_and_weighed(spark):
    docs = docs_of(spark, [f"text {i}" for i in range(400)])
    table = docs.select("doc_id", (F.col("doc_id") % 10 > 0).cast("int").alias("quality"))
    rows = quality.sample(docs, table, rows=20).collect()
    by = collections.Counter(r["label"] for r in rows)
    assert by == {0: 20, 1: 20}
    weight = {r["label"]: r["weight"] for r in rows}
    assert 0.1 < weight[0] < 0.3 and weight[0] + weight[1] == pytest.approx(2)


def test_held_out_accuracy(spark):
    docs, labels = [spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")]
    rows = quality.judge(docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 50 and sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.95


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.judge(docs_of(spark, ODD, ids=[None, 5, 5, *range(100, 97 + len(ODD))]), labels).collect()
    assert len(got) == len(ODD) and all(r["score"] == 0.5 and r["predicted"] == 1 for r in got)
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    assert quality.judge(docs_of(spark, []), labels).count() == 0
    scored = quality.score(docs_of(spark, ["a b", "a b", None]), np.ones(quality.SIZE + 1)).collect()
    assert scored[0]["score"] > scored[2]["score"] or scored[2]["payload"]["doc_id"] != 2
    assert scored[0]["payload"]["payload"] == 7
