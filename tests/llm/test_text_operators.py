"""Language ID, licences, decontamination, host rules: accuracy, brute force and odd input."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from odd_documents import ODD, SF_SMALL, docs_of
from strideframe.llm import decontaminate as D
from strideframe.llm import host_rules, langid, licences


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


# --- language ID -------------------------------------------------------------

def test_language_held_out_accuracy(spark, docs):
    got = langid.languages_of(docs).join(docs.select("doc_id", "lang"), "doc_id")
    held = got.filter("held_out").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]
    assert held > 0.97
    share = got.agg(F.avg(F.col("held_out").cast("int"))).first()[0]
    assert 0.2 < share < 0.3


def test_code_lengths_equal_the_definition():
    """The table of code lengths against method C written down directly."""
    import math

    import numpy as np
    import pyarrow as pa

    order, texts = 2, {"aa": [b"abracadabra", b"abab"], "bb": [b"bbbb cc", b""]}
    rows = []
    for lang, ts in texts.items():
        counts = Counter()
        for t in ts:
            padded = b"\0" * order + t
            for i in range(len(t)):
                for o in range(order + 1):
                    s = padded[i + order - o:i + order + 1]
                    counts[o, int.from_bytes(s, "big")] += 1
        rows += [(lang, o, g, n) for (o, g), n in counts.items()]
    model = langid.build(pa.table({k: [r[i] for r in rows] for i, k in enumerate(("lang", "o", "g", "n"))}), ["aa", "bb"], order)

    def bits(lang, text):
        followers = {}
        for t in texts[lang]:
            padded = b"\0" * order + t
            for i in range(len(t)):
                for o in range(order + 1):
                    followers.setdefault(padded[i + order - o:i + order], Counter())[padded[i + order]] += 1
        total, padded = 0.0, b"\0" * order + text
        for i in range(len(text)):
            for o in range(order, -2, -1):
                if o < 0:
                    total += 8
                    break
                seen = followers.get(padded[i + order - o:i + order])
                if not seen:
                    continue
                n = sum(seen.values())
                k = seen[padded[i + order]]
                if k:
                    total += -math.log2(k / (n + len(seen)))
                    break
                total += -math.log2(len(seen) / (n + len(seen)))
        return total

    for text in (b"abra", b"cab", b"zz", b"bb cc", b"a", b"\0a"):
        got = model.code_lengths(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0] / langid.PARTS
        for k, lang in enumerate(("aa", "bb")):
            assert abs(got[k] - bits(lang, text)) < 0.01 * (len(text) + 1), (text, lang)


def test_language_of_odd_texts(spark, docs):
    model = langid.train(docs.select("lang", "text"), rows=50)
    got = {r["payload"]["doc_id"]: r for r in langid.predict(docs_of(spark, ODD), model).collect()}
    assert len(got) == len(ODD)
    for i, t in enumerate(ODD):
        letter = t is not None and any(c.isalpha() for c in t)
        assert (got[i]["lang_pred"] == "und") == (not letter) and 0 <= got[i]["score"] <= 1
    none = langid.train(docs.filter("false").select("lang", "text"))
    assert [r["lang_pred"] for r in langid.predict(docs_of(spark, ["hello"]), none).collect()] == ["und"]
    assert langid.languages_of(docs_of(spark, [])).count() == 0
    kept = langid.identified(docs_of(spark, ["hello there", None, "12"], ids=[None, 1, 1]))
    assert kept.columns == docs_of(spark, []).columns and {r["text"] for r in kept.collect()} <= {"hello there"}


def test_language_of_copies_is_learned(spark):
    """A language whose few texts have many copies each is learned from all of them."""
    rows = [(f"wort{'abcdefgh'[i % 8] * (1 + i // 8)} und dann noch haus nummer {i}", "zz") for i in range(40)]
    many = spark.createDataFrame(rows, "text string, lang string").crossJoin(spark.range(200)).drop("id")
    other = spark.createDataFrame([(f"plain words of line {i}", "aa") for i in range(30)], "text string, lang string")
    model = langid.train(many.unionByName(other), rows=40)
    assert model.languages == ["aa", "zz"]
    alone = langid.train(spark.createDataFrame(rows, "text string, lang string").unionByName(other), rows=40)
    assert all((a == b).all() for a, b in zip(model.cost, alone.cost))
    assert [r["lang_pred"] for r in langid.predict(docs_of(spark, ["wort und haus"]), model).collect()] == ["zz"]


def test_identified_rejects_by_code_length_and_fills_languages(spark, docs):
    foreign = "\u0416\u9f98\u0e01\ua000\u1200\u10d0 " * 3
    table = docs.select("doc_id", "text", "lang").unionByName(
        spark.createDataFrame([(-1, foreign, "en"), (-2, None, "en"), (-3, "12 34", None)], "doc_id long, text string, lang string"))
    blank = table.withColumn("lang", F.when(F.col("doc_id") % 10 != 0, F.col("lang")))
    model = langid.train(blank.filter(langid.fold() != 2).select("lang", "text"))
    want = {}
    for r in blank.collect():
        raw = (r["text"] or "").encode()
        if not any(c.isalpha() for c in r["text"] or ""):
            continue
        bits = model.code_lengths(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0] / langid.PARTS
        if bits.min() < 8 * len(raw):
            want[r["doc_id"]] = r["lang"] or model.languages[int(bits.argmin())]
    got = {r["doc_id"]: r["lang"] for r in langid.identified(blank).collect()}
    assert got == want and not {-1, -2, -3} & set(got) and None not in got.values()
    assert langid.identified(blank, plain_bits=2.0).count() < len(got)


# --- licences ------------------------------------------------------------------

def test_licences_are_found_and_named(spark, docs):
    got = licences.licences_of(docs).join(docs.select("doc_id", "text"), "doc_id").collect()
    planted = {"Licensed under CC BY-NC 4.0.": "cc-by-nc", "Licensed under the Apache License, Version 2.0.": "apache",
               "Released under the MIT License.": "mit", "GNU General Public License, version 3": "gpl"}
    n = 0
    for r in got:
        want = {f for t, f in planted.items() if r["text"] and t in r["text"]}
        n += bool(want)
        assert (r["licence"] in want) if want else r["licence"] is None, r["text"][:200]
    assert n > 20


def test_licence_scan_of_odd_texts(spark):
    model = licences.train(["some words of a text that has nothing to do with it", "and another"] * 50)
    texts = ODD + ["x\nReleased under the MIT License.\nfoo", "the license of a bar was renewed by the public office",
                   "Licensed under CC BY-SA 4.0."]
    got = {r["payload"]["doc_id"]: [x["family"] for x in r["licences"] if x["confirmed"]] for r in licences.scan(docs_of(spark, texts), model).collect()}
    assert len(got) == len(texts) and all(not got[i] for i in range(len(ODD)))
    assert got[len(ODD)] == ["mit"] and got[len(ODD) + 1] == [] and got[len(ODD) + 2] == ["cc-by-sa"]
    assert licences.licences_of(docs_of(spark, [])).count() == 0


def test_common_licences_and_small_tables(spark):
    """A licence is found however few rows there are and however common its words are."""
    small = docs_of(spark, ["Some words.\nReleased under the MIT License.", "nothing here", "Licensed under CC BY-SA 4.0."])
    assert {r["doc_id"]: r["licence"] for r in licences.licences_of(small).collect()} == {0: "mit", 1: None, 2: "cc-by-sa"}
    rng = random.Random(5)
    prose = [" ".join(f"w{rng.randint(0, 500)}" for _ in range(12)) for _ in range(600)]
    hot = {i: f"(c) {1980 + i % 45} w{rng.randint(0, 500)} w{rng.randint(0, 500)}. Released under the MIT License." for i in range(0, 600, 3)}
    texts = [f"{t}\n{hot[i]}" if i in hot else t for i, t in enumerate(prose)]
    got = {r["doc_id"]: r["licence"] for r in licences.licences_of(docs_of(spark, texts)).collect()}
    assert got == {i: "mit" if i in hot else None for i in range(600)}


MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files "
       "(the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify.")
BSD = ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\n"
       "are met:\n1. Redistributions of source code must retain the above notice.")
GPL = ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\n"
       "the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.")


def test_wrapped_notices(spark):
    """Notices wrapped over lines, in comments, within long lines and twice; not across a blank line."""
    rng = random.Random(6)
    prose = lambda n: " ".join(f"w{rng.randint(0, 500)}" for _ in range(n))
    marked = lambda t, m: "\n".join(m + x for x in t.split("\n"))
    texts = [f"{prose(9)}\n\n{t}\n\n{prose(9)}" for t in (MIT, BSD, GPL)]
    texts += [f"{prose(9)}\n{marked(t, m)}\n{prose(9)}" for t, m in ((MIT, "# "), (BSD, " * "), (GPL, "// "), (MIT, "dnl "), (GPL, "REM "))]
    texts += [f"{prose(300)} {BSD} {prose(300)}".replace("\n", " "), f"{MIT}\n\n{prose(5)}\n\n{MIT}", f"{MIT}\n{GPL}"]
    texts += [BSD.replace("\n", "\n#\n"), prose(50), "All rights reserved."]
    want = ["mit", "bsd", "gpl", "mit", "bsd", "gpl", "mit", "gpl", "bsd", "mit", None, None, None, None]
    model = licences.train([prose(12) for _ in range(400)] + [x for t in (MIT, BSD, GPL) for x in t.split("\n")] * 40)
    got = {r["payload"]["doc_id"]: [x["family"] for x in r["licences"] if x["confirmed"]] for r in licences.scan(docs_of(spark, texts), model).collect()}
    assert [got[i] for i in range(9)] == [[w] for w in want[:9]]
    assert got[9] == ["mit", "mit"] and got[10] == ["mit", "gpl"] and got[11] == got[12] == got[13] == []
    found = {r["doc_id"]: r["licence"] for r in licences.licences_of(docs_of(spark, texts)).collect()}
    assert [found[i] for i in range(14)] == want[:10] + [found[10]] + want[11:] and found[10] in ("mit", "gpl")


# --- decontamination ---------------------------------------------------------------

def _edited(rng, text, k):
    s = list(text)
    for _ in range(k):
        p, o = rng.randrange(len(s)), rng.choice("ids")
        if o == "i":
            s.insert(p, rng.choice("abcdefgh "))
        elif o == "d":
            del s[p]
        else:
            s[p] = rng.choice("abcdefgh")
    return "".join(s)


def test_edit_distance_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(200):
        p = "".join(rng.choice("ab") for _ in range(rng.randint(1, 12)))
        t = "".join(rng.choice("ab") for _ in range(rng.randint(0, 25)))
        row = list(range(len(p) + 1))
        best = row[-1]
        for c in t:
            new = [0]
            for i, x in enumerate(p):
                new.append(min(new[i] + 1, row[i + 1] + 1, row[i] + (x != c)))
            row = new
            best = min(best, row[-1])
        assert D.best_distance(p.encode(), t.encode())[0] == best


def test_recall_at_the_allowed_distance(spark):
    """Against brute force over all items and documents: recall of the LSH at least 0.99 over all distances, no false row."""
    rng = random.Random(2)
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()]
    filler = [r["text"][:300] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").filter("length(text) > 300").collect()]
    items = D.Items([(i, D.normalise(t)) for i, t in bench])
    texts = []
    for _, t in bench:
        n = D.normalise(t)
        for part in (0, 0.5, 1.0):
            texts.append(f"{rng.choice(filler)} {_edited(rng, n.decode(), int(D.allowed(len(n)) * part))} {rng.choice(filler)}")
    found = D.leaks_in(texts, items)
    want = hit = 0
    for k, text in enumerate(texts):
        item_id, raw = bench[k // 3]
        n = D.normalise(raw)
        if D.best_distance(n, D.normalise(text))[0] <= D.allowed(len(n)):
            want += 1
            hit += any(i == item_id for i, _, _ in found[k])
        for i, edits, _ in found[k]:
            own = items.texts[items.ids.index(i)]
            assert edits <= D.allowed(len(own)) and edits >= D.best_distance(own, D.normalise(text))[0]
    assert want > 500 and hit >= 0.99 * want


@pytest.mark.parametrize("size,trials", [(1 << 10, 40), (2 << 10, 24), (4 << 10, 16), (16 << 10, 4)])
def test_recall_of_long_items_at_the_allowed_distance(size, trials):
    """Word text with exactly as many random edits as are allowed."""
    rng = random.Random(size)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n // 4))[:n].strip()
    texts = [prose(size) for _ in range(trials)]
    items = D.Items([(i, t.encode()) for i, t in enumerate(texts)])
    found = D.leaks_in([f"{prose(300)} {_edited(rng, t, D.allowed(len(t)))} {prose(300)}" for t in texts], items)
    assert all(e <= D.allowed(len(texts[i])) and i == k for k, f in enumerate(found) for i, e, _ in f)
    assert sum(bool(f) for f in found) >= 0.99 * trials


def test_decontamination_of_odd_texts_and_items(spark):
    bench = spark.createDataFrame([(1, "Same  TEXT here"), (2, None), (3, ""), (4, "x" * 300), (5, "tiny"), (None, "null id"), (1, "Same text here")],
                                  "item_id long, text string").withColumn("extra", F.lit(1))
    texts = ODD + ["a tiny thing", "tinyness"]
    docs = docs_of(spark, texts)
    for block in (1, 1 << 20):
        got = {r["payload"]["doc_id"]: {x["item_id"] for x in r["leaks"]} for r in D.annotate(docs, bench, block).collect()}
        want = {i: set() for i in range(len(texts))}
        want[8] = {4}
        want[12] = want[13] = {1}
        want[len(ODD)] = {5}
        assert got == want
    clean = D.clean(docs, bench)
    assert clean.columns == docs.columns and clean.count() == len(texts) - 4
    assert D.clean(docs, bench.filter("false")).count() == len(texts)
    assert D.leaks(docs_of(spark, []), bench).count() == 0


# --- host rules ----------------------------------------------------------------

def _brute_repeat(words):
    seen = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    cover = set()
    for i in range(len(words) - 7):
        if seen[tuple(words[i:i + 8])] > 1:
            cover |= set(range(i, i + 8))
    return len(cover)


def test_repeated_words_equal_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        words = [rng.choice([b"a", b"b"]) for _ in range(rng.randint(0, 40))]
        assert host_rules.repeated_words(words) == _brute_repeat(words)


def test_hosts_with_bad_texts_go(spark):
    rng = random.Random(4)
    good = [" ".join(f"w{rng.randint(0, 9999)}" for _ in range(30)) for _ in range(200)]
    a = docs_of(spark, good[:100], ids=list(range(100)), source="fine.org")
    b = docs_of(spark, ["short"] * 95 + good[100:105], ids=list(range(100, 200)), source="bad.org")
    c = docs_of(spark, ["few"] * 2 + good[110:111], ids=list(range(200, 203)), source="small.org")
    d = docs_of(spark, ODD, ids=list(range(300, 300 + len(ODD))), source=None)
    out = {r["doc_id"]: r for r in host_rules.judge(a.union(b).union(c).union(d)).collect()}
    assert len(out) == 203 + len(ODD)
    assert all(out[i]["kept"] for i in range(100)) and not any(out[i]["kept"] for i in range(100, 200))
    assert not out[195]["base_failed"] and out[202]["kept"]
    for i, t in enumerate(ODD):
        r, words = out[300 + i], (t or "").encode().split()
        assert r["n_words"] == len(words) and r["word_chars"] == sum(len(w.decode()) for w in words)
        if len(words) < 100:
            assert r["n_repeat_words"] == _brute_repeat(words)
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        assert r["n_dup_lines"] == len(lines) - len(set(lines)) and r["host_rate"] is None
    assert host_rules.judge(docs_of(spark, [])).count() == 0
