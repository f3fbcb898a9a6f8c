"""SimHash, suffix dedup, components, quotes, host reputation and the pipeline against brute force."""

import hashlib
import os
import random
import sys
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from odd_documents import ODD, SF_SMALL, docs_of
from strideframe.llm import host_reputation, langid, quotes, simhash, suffixes
from strideframe.llm.components import components

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))


# --- components ---------------------------------------------------------------

def _components(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(80)] + [(300, 300)] + \
        [(rng.randint(400, 460), rng.randint(400, 460)) for _ in range(40)]
    rng.shuffle(pairs)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = {k: v for k, v in _components(pairs).items() if k != v}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- SimHash ----------------------------------------------------------------------

def _fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_golay_segments_two_bits_apart_share_an_index():
    near = defaultdict(set)
    for w in range(5):
        for bits in combinations(range(23), w):
            e = sum(1 << b for b in bits)
            near[simhash.syndrome(e)].add(e)
    assert Counter(map(len, near.values())) == {6: 1771, 1: 277}
    flips = [1 << a | 1 << b for a, b in combinations(range(23), 2)] + [1 << a for a in range(23)]
    for f in flips:
        s = simhash.syndrome(f)
        assert all(any(e ^ f in near[k ^ s] for e in near[k]) for k in near)


def test_keys_of_close_fingerprints_meet():
    rng = np.random.RandomState(2)
    for _ in range(300):
        x = int(rng.randint(0, 1 << 62)) * 4 + int(rng.randint(0, 4))
        y = x
        for b in rng.choice(64, rng.randint(0, 5), replace=False):
            y ^= 1 << int(b)
        r, k = simhash.bucket_keys(np.array([x, y], np.uint64))
        assert set(k[r == 0].tolist()) & set(k[r == 1].tolist())


def test_dense_and_small_buckets_link_the_same():
    rng = np.random.RandomState(3)
    fp = np.unique((np.uint64(12345) ^ sum((np.uint64(1) << rng.randint(0, 10, 90).astype(np.uint64)) for _ in range(2))).astype(np.uint64))
    far = rng.randint(0, 1 << 62, 50).astype(np.uint64)
    for bucket in (np.zeros(len(fp) + 50, np.int64), np.r_[np.zeros(len(fp)), np.arange(50) // 5 + 1].astype(np.int64)):
        a, b = simhash.forest(bucket, np.r_[fp, far])
        assert all(len({int(x) for x in (p, q)}) == 2 for p, q in zip(a, b))
        every = np.r_[fp, far]
        pairs = [(int(x), int(y)) for i, x in enumerate(every) for j, y in enumerate(every) if i < j and bucket[i] == bucket[j]
                 and int(x ^ y).bit_count() <= 4]
        want = {k: v for k, v in _components(pairs).items() if k != v}
        assert {int(x): int(y) for x, y in zip(a, b)} == want


def _near(ids, texts):
    fps = [_fingerprint(t) for t in texts]
    kinds = sorted(set(fps))
    root = _components([(a, b) for a, b in combinations(kinds, 2) if (a ^ b).bit_count() <= 4] + [(a, a) for a in kinds])
    least = {}
    for i, f in zip(ids, fps):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    return fps, [least.get(root[f]) for f in fps]


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(5, 120))] for _ in range(40)]
    texts = list(ODD)
    for words in base:
        for _ in range(rng.randint(1, 6)):
            w = list(words)
            if rng.random() < 0.7:
                w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w).upper() if rng.random() < 0.3 else "\t".join(w))
    ids = [None, *range(10, 9 + len(texts))]
    ids[20] = ids[21]
    docs = docs_of(spark, texts, ids)
    fps, want = _near(ids, texts)
    for hot in (False, True):
        if hot:  # all buckets of more than a few fingerprints in blocks
            monkeypatch.setattr(simhash, "BLOCK", 2)
            monkeypatch.setattr(simhash, "SAMPLE", 1)
            monkeypatch.setattr(simhash, "HOT_SHARE", 0.0)
        got = simhash.near_duplicates(docs).collect()
        assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=repr) == \
            sorted(((i, f"{f:016x}", c) for i, f, c in zip(ids, fps, want)), key=repr)
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({c for c in want})
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0 and simhash.representatives(docs_of(spark, [])).count() == 0


# --- suffix dedup ------------------------------------------------------------------

def _removed(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[p:p + length] for b in raw for p in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, np.int8)
        for p in range(len(b) - length + 1):
            if count[b[p:p + length]] > 1:
                gone[p:p + length] = 1
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), int(gone.sum()), int((np.diff(np.r_[0, gone]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length,gram,spread", [(20, 8, 512), (20, 8, 2), (20, 8, 0), (200, 64, 3)])
def test_repeats_equal_brute_force(spark, length, gram, spread):
    rng = random.Random(length + spread)
    base = "".join(rng.choice("abcdeé ") for _ in range(2500))
    texts = [t for t in ODD if t is None or len(t) < 5000] + ["ab" * 300, "a" * 700, "a" * 700]
    for _ in range(80):
        s = "".join(rng.choice("abcdeé ") for _ in range(rng.randint(0, 150)))
        for _ in range(rng.randint(0, 3)):
            p = rng.randint(0, 2400)
            s += base[p:p + rng.randint(5, 400)] + "".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))
        texts.append(s)
    texts += texts[20:28] + [texts[22]] * 6
    ids = [None, *range(1, len(texts) - 6), *[7] * 6]
    got = suffixes.cut_repeats(docs_of(spark, texts, ids), length, gram, spread).collect()
    mine = sorted((repr((r["payload"]["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in got))
    assert mine == sorted(repr((i, *x)) for i, x in zip(ids, _removed(texts, length)))


def test_repeats_keep_columns_and_tables(spark):
    docs = docs_of(spark, [None, "é" * 150, "é" * 150, "short", ""])
    out = suffixes.without_repeats(docs)
    assert out.columns == docs.columns and sorted(r["text"] or "-" for r in out.collect()) == ["-", "-", "-", "-", "short"]
    assert suffixes.repeat_digests(docs_of(spark, [])).count() == 0


def test_loser_tree_merges_and_knows_prefixes():
    rng = random.Random(6)
    runs = [sorted({"".join(rng.choice("ab") for _ in range(rng.randint(0, 12))).encode() for _ in range(40)}) for _ in range(7)] + [[]]
    coded = [suffixes.read_run(suffixes.front_code([(s, b"", [(1, 2)]) for s in r])) for r in runs]
    out = list(suffixes.LoserTree(coded))
    assert [s for _, s, _ in out] == sorted(s for r in runs for s in r)
    for (_, a, _), (n, b, _) in zip(out, out[1:]):
        assert n == len(os.path.commonprefix([a, b]))
    assert list(suffixes.LoserTree([])) == []


# --- quotes -------------------------------------------------------------------------

def test_quotes_link_replies(spark):
    rows = [
        (1, 0, "user", "First point.\nSecond point."),
        (1, 1, "assistant", "Unrelated."),
        (1, 2, "user", "Alice wrote:\n> first   POINT.\nI disagree."),
        (1, 3, "assistant", "> I disagree.\n>> First point.\nWhy?"),
        (1, 4, "user", "> nobody said this\nHm."),
        (1, 5, "user", "> Why?\n> Hm.\n> First point.\n> Second point.\nEnd"),
        (2, 0, "user", "> First point.\nother conversation"), (2, 1, None, None), (2, 1, None, None), (2, 2, "user", ""),
        (None, 0, "user", "> First point."), (3, None, "user", "no turn"), (4, 0, "user", ">" * 50),
    ]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("k", F.lit(1)).withColumn("depth", F.lit(1))
    got = quotes.link(t).collect()
    assert len(got) == len(rows)
    one = {r["turn"]: r for r in got if r["conv_id"] == 1}
    assert [one[i]["reply_to"] for i in range(6)] == [None, None, 0, 2, None, 0]
    assert [one[i]["depth"] for i in range(6)] == [0, 0, 1, 2, 0, 1]
    assert one[2]["text"] == "I disagree." and one[3]["text"] == "Why?" and one[3]["quote_level"] == 2
    assert [i for i, _ in sorted(((i, one[i]["position"]) for i in one), key=lambda x: x[1])] == [0, 2, 3, 5, 1, 4]
    assert sorted(r["position"] for r in got if r["conv_id"] == 2) == [1, 2, 3, 4]
    assert all(r["reply_to"] is None for r in got if r["conv_id"] != 1)
    text = quotes.render(quotes.link(t), t.filter("conv_id = 1")).first()["transcript"]
    assert text.split("\n")[0] == "user: First point." and "  user: I disagree." in text
    assert quotes.link(t.filter("false")).count() == 0
    plan = quotes.link(t)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_quotes_equal_duckdb_on_random_threads(spark):
    import duckdb
    import pandas as pd

    rng = random.Random(7)
    rows = []
    for c in range(30):
        said = []
        for t in range(rng.randint(1, 12)):
            own = [f"line {rng.randint(0, 30)} of talk" for _ in range(rng.randint(1, 3))]
            q = [f"{'>' * rng.randint(1, 3)} {rng.choice(said)}" for _ in range(rng.randint(0, 3))] if said else []
            rows.append((c, t, rng.choice(["user", "assistant"]), "\n".join(q + own)))
            said += own
    got = quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).toPandas()
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]))
    want = con.execute(quotes.SQL).fetchall()
    cols = [d[0] for d in con.description]
    clean = lambda v: None if v is None or v != v else (int(v) if isinstance(v, float) else v)
    assert sorted(tuple(map(clean, r)) for r in want) == sorted(tuple(map(clean, r)) for r in got[cols].itertuples(index=False, name=None)) \
        if not got.reply_to.isna().any() else \
        sorted((repr(tuple(map(clean, r))) for r in want)) == sorted(repr(tuple(map(clean, r))) for r in got[cols].itertuples(index=False, name=None))
    assert got.reply_to.notna().sum() > 50


def test_wrapped_and_partial_quotes_link(spark):
    long = "The quick brown fox jumps over the lazy dog near the river bank. It never came back to us after that day in March."
    rows = [
        (1, 0, "user", "Something else entirely was said at first by somebody."), (1, 1, "user", long),
        (1, 2, "user", "> The quick brown fox jumps over the\n> lazy dog near the river bank. It never came back\n> to us after that day in March.\nWrapped."),
        (1, 3, "user", "> It never came back to us after that day in March.\nOne sentence."),
        (1, 4, "user", "> The quick brown fox jumps over\nthe rest is mine."),
        (1, 5, "user", "> The quick brown cat sleeps all day and nobody said any of this\nNo quote."),
        (1, 6, "user", "> Something else entirely was\n>> The quick brown fox jumps over the\n>> lazy dog near the river\nTwo levels."),
        (2, 0, "user", "Here is an original that was\nwrapped by its own author quite early."),
        (2, 1, "user", "> Here is an original that was wrapped by its own author quite early.\nJoined."),
        (3, 0, "user", "> The quick brown fox jumps over the\nother conversation"),
    ]
    linked = quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {(r["conv_id"], r["turn"]): r["reply_to"] for r in linked.collect()}
    assert got == {(1, 0): None, (1, 1): None, (1, 2): 1, (1, 3): 1, (1, 4): 1, (1, 5): None, (1, 6): 0, (2, 0): None, (2, 1): 0, (3, 0): None}
    plan = linked._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- host reputation ---------------------------------------------------------------

def test_rules_hosts_and_paths(spark):
    urls = ["http://A.Example.NET/en/x?y", "https://example.net/EN/", "http://net/", "http://x.net", "http://b.example.com/de/1#f",
            "http://example.com/fr/", "http://a.org/fr/", "http://org/fr", "ftp://x?://y", "no scheme", None, "", "a://b://c", "://", "http://ÄB.net/p"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1))
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in host_reputation.judge_labelled(pages, labels).collect()}
    want = [("a.example.net", "/en/x", "example.net/en/", "allow"), ("example.net", "/EN/", "net/", "block"), ("net", "/", "net/", "block"),
            ("x.net", "", None, None), ("b.example.com", "/de/1", "example.com/de/", "block"), ("example.com", "/fr/", None, None),
            ("a.org", "/fr/", "org/fr/", "allow"), ("org", "/fr", None, None), ("x", "", None, None), ("", "", None, None), ("", "", None, None),
            ("", "", None, None), ("b:", "//c", None, None), ("", "", None, None), ("Äb.net", "/p", "net/", "block")]
    for i, (host, path, rule, verdict) in enumerate(want):
        assert got[i][:3] == (host, path, rule), (urls[i], got[i])
        if verdict:
            assert got[i][3] == verdict
    assert host_reputation.judge_labelled(pages.filter("false"), labels).count() == 0


def test_bad_hosts_are_blocked_and_unknown_ones_take_their_domains_rate(spark):
    rows, bad = [], []
    for h, n, b in (("spam.one.xyz", 60, 58), ("more.one.xyz", 50, 48), ("fine.two.xyz", 80, 2), ("ok.three.abc", 90, 3), ("tiny.three.abc", 2, 2)):
        for _ in range(n):
            rows.append((len(rows), f"http://{h}/en/{len(rows)}"))
            bad.append((len(bad), int(len([x for x in bad if x[2] == h and x[1]]) < b), h))
    rows += [(9000, "http://new.one.xyz/en/9000"), (9001, "http://new.three.abc/en/9001")]
    labels = spark.createDataFrame([(i, 1, b) for i, b, _ in bad], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in host_reputation.judge_labelled(spark.createDataFrame(rows, "page_id long, url string"), labels).collect()}
    verdict = {h: got[next(i for i, _, x in bad if x == h)]["verdict"] for h in {x for _, _, x in bad}}
    assert verdict["spam.one.xyz"] == verdict["more.one.xyz"] == "block"
    assert verdict["fine.two.xyz"] == verdict["ok.three.abc"] == "allow"
    assert got[9000]["bad_rate"] > got[9001]["bad_rate"]
    plan = host_reputation.judge_labelled(spark.createDataFrame(rows, "page_id long, url string"), labels)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- registered queries and the pipeline ----------------------------------------------

def test_queries_match_duckdb(spark):
    from oracle_compare import compare, duck
    from strideframe.llm.queries import ORACLE, QUERIES

    con = duck(SF_SMALL)
    for name, sql in ORACLE.items():
        r = compare(spark, SF_SMALL, name, QUERIES[name], sql, con)
        assert r["status"] == "match", r
    assert len(QUERIES) == 10


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline
    import public_tokenizers
    from strideframe.llm import decontaminate as D
    from tokenizers import Tokenizer

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    bench = [D.normalise(r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    rows = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    documents = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    model = langid.train(documents.filter(langid.fold() != 2).select("lang", "text"))
    coded = lambda b: model.code_lengths(np.frombuffer(b, np.uint8), np.array([0, len(b)])).min() / langid.PARTS
    rows = [(i, t) for i, t in rows if coded(t.encode()) < 8 * len(t.encode())]
    _, comp = _near([i for i, _ in rows], [t for _, t in rows])
    rows = [(i, t) for (i, t), c in zip(rows, comp) if i == c]
    count = Counter()
    raw = {i: t.encode() for i, t in rows}
    for b in raw.values():
        count.update(b[p:p + 200] for p in range(len(b) - 199))
    kept = {}
    for i, b in raw.items():
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 199):
            if count[b[p:p + 200]] > 1:
                gone[p:p + 200] = True
        kept[i] = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
    def leaks(text):
        n = D.normalise(text)
        return any(D.best_distance(x, n)[0] <= D.allowed(len(x)) for x in bench)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in kept.items() if not leaks(t)}
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in corpus_pipeline.run(spark, SF_SMALL).collect()}
    assert got == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "repeated_passages", "benchmark_leaks", "token_ids"]


def test_stages_stand_odd_documents(spark):
    import corpus_pipeline

    docs = docs_of(spark, ODD, ids=[None, *range(len(ODD) - 2), 0])
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.filter("false")):
            out = stage(spark, table, SF_SMALL)
            n = out.count()
            assert n <= len(ODD)
            if name != "token_ids":
                assert out.columns == docs.columns
