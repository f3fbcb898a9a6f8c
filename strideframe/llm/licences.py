"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs end at blank lines (a line of comment marks alone is blank).  Two
kinds of passages can name a licence: single lines, and windows of a
paragraph's joined words that hold enough of a template, so a notice may be
wrapped over lines anywhere or stand within a long line.  Where passages
overlap, the one that holds more of a template counts.

Sparse word n-grams (one to three words) of a passage feed a softmax
regression over licence families and an unknown class.  It is trained here:
positives are the templates, varied by dropping and adding words, and
paragraphs of a bounded sample that hold a template; the unknown class is the
rest of the sample.  A held-out part of the training rows calibrates the
scores (temperature), so that a family is only named where its calibrated
probability passes the threshold.  A named family is confirmed if the
passage holds enough of one of the family's templates.

Every line is scored that shares an n-gram with a template, however common its
words are in the corpus.

The model is small (its n-grams come from the templates and the commonest of
the sample) and broadcast; every line and window of every text is classified
where Spark reads it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_chunks, row_key, text_buffer, with_rows

#: Notices of licence families (public texts), by family.
TEMPLATES = {
    "apache": ("Licensed under the Apache License, Version 2.0.",
               "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
            "Released under the BSD 3-Clause License."),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "cc-by-nc": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."),
    "cc-by-sa": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related rights to this work.", "Dedicated to the public domain under CC0 1.0."),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    "mit": ("Released under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "proprietary": ("All rights reserved. No part of this publication may be reproduced without permission.",),
}
UNKNOWN = "unknown"
#: Paragraphs of the corpus in the training sample, at most.
SAMPLE_PARAGRAPHS = 6000
#: Words of the longest n-gram.
GRAMS = 3
#: Commonest n-grams of the sample that are features besides those of the templates.
COMMON = 2000
#: Calibrated probability at which a family is named, and share of a template's word pairs that confirms it.
NAMED = 0.6
CONFIRMED = 0.7
VARIANTS = 40
#: Bytes of text whose words are held at once.
SCAN_BYTES = 1 << 20
#: A window is at most so many times as long as its template.
WIDTH = 2
#: Words that mark a line as a comment; other comment marks are no words.
COMMENTS = {b"rem", b"dnl"}
SEED = 11

_SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum() and b not in b"\n")
_CLEAN = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))


def words_of(paragraph: bytes) -> list[bytes]:
    return paragraph.lower().translate(_CLEAN).split()


def grams_of(words: list[bytes]) -> set[bytes]:
    return {b" ".join(words[i:i + n]) for n in range(1, GRAMS + 1) for i in range(len(words) - n + 1)}


@dataclass
class Model:
    families: list[str]  # the unknown class is first
    features: dict[bytes, int]
    own: np.ndarray  # features that are n-grams of templates
    weight: np.ndarray  # feature x class
    bias: np.ndarray
    temperature: float
    pairs: dict[str, list[set[bytes]]] = field(default_factory=dict)  # word pairs of the templates

    def probabilities(self, rows: list[list[int]]) -> np.ndarray:
        """Calibrated class probabilities of paragraphs given by their feature numbers."""
        return softmax(scores(rows, self.weight, self.bias) / self.temperature)

    def features_of(self, words: list[bytes]) -> list[int]:
        get = self.features.get
        return sorted({k for g in grams_of(words) if (k := get(g)) is not None})

    def similarity(self, words: list[bytes], family: str) -> float:
        """Largest share of a family template's word pairs that the paragraph holds."""
        have = _pairs(words)
        return max((len(have & t) / len(t) for t in self.pairs[family] if t), default=0.0)

    def __post_init__(self):
        #: Numbers of the features' words, from 1, and by n the sorted codes of the n-grams with their features.
        self.numbers = {w: i for i, w in enumerate(sorted({w for g in self.features for w in g.split(b" ")}), 1)}
        self.base = len(self.numbers) + 1
        #: By feature, the templates whose word pair it is; by template, its word pairs and the words of a window.
        self.templates = [(len(t), WIDTH * (len(t) + 1)) for ts in self.pairs.values() for t in ts]
        self.holds: dict[int, list[int]] = {}
        for i, t in enumerate(t for ts in self.pairs.values() for t in ts):
            for pair in t:
                if b" " in pair:
                    self.holds.setdefault(self.features[pair], []).append(i)
        self.codes = []
        for n in range(1, GRAMS + 1):
            some = sorted((self._code(g), k) for g, k in self.features.items() if g.count(b" ") == n - 1)
            self.codes.append((np.array([c for c, _ in some], np.int64), np.array([k for _, k in some], np.int64)))

    def _code(self, gram: bytes) -> int:
        code = 0
        for w in gram.split(b" "):
            code = code * self.base + self.numbers[w]
        return code

    def grams_at(self, numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """By n: (n, places, features) of the n-grams of a run of words that are features."""
        code = np.zeros(len(numbers), np.int64)
        for n, (known, feature) in enumerate(self.codes, 1):
            if len(numbers) < n or not len(known):
                return
            code = code[:len(numbers) - n + 1] * self.base + numbers[n - 1:]
            at = np.minimum(np.searchsorted(known, code), len(known) - 1)
            places = np.flatnonzero(known[at] == code)
            yield n, places, feature[at[places]]

    def scan(self, texts: list[bytes]) -> list[list[tuple[str, float, float, bool]]]:
        """For each text (family, probability, similarity, confirmed) of the passages that name a licence, in the text's order."""
        words, ends, first_lines = [], [], []
        for text in texts:
            first_lines.append(len(ends))
            for line in text.lower().translate(_CLEAN).split(b"\n"):
                some = line.split()
                words += some[1:] if some and some[0] in COMMENTS else some
                ends.append(len(words))
        out: list[list[tuple[str, float, float, bool]]] = [[] for _ in texts]
        if not words:
            return out
        get = self.numbers.get
        numbers = np.array([get(w, 0) for w in words], np.int64)
        size = np.diff(ends, prepend=0)
        line = np.repeat(np.arange(len(ends)), size)
        breaks = size == 0
        breaks[first_lines] = True
        paragraph = np.repeat(np.cumsum(breaks), size)
        of, feature, spans = [], [], []
        for n, at, k in self.grams_at(numbers):
            same = line[at] == line[at + n - 1]
            of.append(line[at[same]])
            feature.append(k[same])
            if n == 2:
                same = paragraph[at] == paragraph[at + 1]
                spans = self.windows(at[same], k[same], paragraph[at[same]])
        both = np.unique(np.concatenate(of) * len(self.features) + np.concatenate(feature))
        of, feature = np.divmod(both, len(self.features))
        shares = np.unique(of[self.own[feature]])  # lines that share an n-gram with a template
        first, last = np.searchsorted(of, shares).tolist(), np.searchsorted(of, shares, "right").tolist()
        rows = [feature[a:b] for a, b in zip(first, last)] + [np.array(self.features_of(words[a:b]), np.int64) for a, b in spans]
        spans = [(ends[i] - int(size[i]), ends[i]) for i in shares.tolist()] + spans
        if not rows:
            return out
        z = np.stack([self.bias + self.weight[r].sum(0) for r in rows])
        p = softmax(z / self.temperature)
        named = []
        for i in np.flatnonzero(p[:, 1:].max(1) >= NAMED).tolist():
            k, (a, b) = 1 + int(p[i, 1:].argmax()), spans[i]
            s = self.similarity(words[a:b], self.families[k])
            named.append((a, b, (self.families[k], float(p[i, k]), s, s >= CONFIRMED)))
        text_of = np.searchsorted(first_lines, np.arange(len(ends)), "right") - 1
        for a, _, found in apart(named):
            out[text_of[line[a]]].append(found)
        return out

    def windows(self, places: np.ndarray, features: np.ndarray, paragraph: np.ndarray) -> list[tuple[int, int]]:
        """(start, end) of the windows that hold enough word pairs of a template, from the places of the known pairs."""
        cuts = np.r_[0, np.flatnonzero(np.diff(paragraph)) + 1, len(places)]
        least = CONFIRMED * min((n for n, _ in self.templates), default=1)
        out = []
        for c in np.flatnonzero(np.diff(cuts) >= least).tolist():
            held: dict[int, list[tuple[int, int]]] = {}
            for at, k in zip(places[cuts[c]:cuts[c + 1]].tolist(), features[cuts[c]:cuts[c + 1]].tolist()):
                for t in self.holds.get(k, ()):
                    held.setdefault(t, []).append((at, k))
            for t, hits in held.items():
                n, width = self.templates[t]
                if len({k for _, k in hits}) >= CONFIRMED * n:
                    out += fullest(hits, CONFIRMED * n, width)
        return sorted(set(out))


def fullest(hits: list[tuple[int, int]], least: float, width: int) -> list[tuple[int, int]]:
    """(start, end) of runs of at most ``width`` words with ``least`` different pairs, the fullest of those that overlap."""
    out: list[tuple[int, int, int]] = []
    seen: Counter = Counter()
    left = 0
    for at, k in hits:
        seen[k] += 1
        while hits[left][0] + width < at + 2 or seen[hits[left][1]] > 1:
            old = hits[left][1]
            seen[old] -= 1
            if not seen[old]:
                del seen[old]
            left += 1
        if len(seen) >= least:
            found = (hits[left][0], at + 2, len(seen))
            if not out or found[0] >= out[-1][1]:
                out.append(found)
            elif found[2] > out[-1][2]:
                out[-1] = found
    return [(a, b) for a, b, _ in out]


def apart(named: list[tuple[int, int, tuple]]) -> list[tuple[int, int, tuple]]:
    """Of passages that overlap, the confirmed, most similar, most probable, shortest; in order."""
    out: list[tuple[int, int, tuple]] = []
    for x in sorted(named, key=lambda x: (-x[2][3], -x[2][2], -x[2][1], x[1] - x[0], x)):
        i = bisect_left(out, x)
        if (i == 0 or out[i - 1][1] <= x[0]) and (i == len(out) or x[1] <= out[i][0]):
            out.insert(i, x)
    return out


def _pairs(words: list[bytes]) -> set[bytes]:
    return {b" ".join(words[i:i + 2]) for i in range(len(words) - 1)} if len(words) > 1 else set(words)


def scores(rows: list[list[int]], weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    size = np.array([len(r) for r in rows])
    out = np.tile(bias, (len(rows), 1))
    if size.sum():
        flat = np.concatenate([np.array(r, np.int64) for r in rows if r])
        full = np.flatnonzero(size)
        starts = np.r_[0, np.cumsum(size[full])[:-1]]
        out[full] += np.add.reduceat(weight[flat], starts, axis=0)
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(rows: list[list[int]], labels: np.ndarray, n_features: int, n_classes: int, steps: int = 150, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression by full-batch gradient descent with per-weight step sizes; classes count alike."""
    size = np.array([len(r) for r in rows])
    flat = np.concatenate([np.array(r, np.int64) for r in rows if r] or [np.empty(0, np.int64)])
    of = np.repeat(np.arange(len(rows)), size)
    target = np.eye(n_classes)[labels]
    share = 1.0 / np.maximum(1, target.sum(0))[labels] / n_classes
    weight, bias = np.zeros((n_features, n_classes)), np.zeros(n_classes)
    gw, gb = np.full_like(weight, 1e-8), np.full_like(bias, 1e-8)
    for _ in range(steps):
        error = (softmax(scores(rows, weight, bias)) - target) * share[:, None]
        dw = np.stack([np.bincount(flat, error[of, c], n_features) for c in range(n_classes)], 1) + l2 * weight
        db = error.sum(0)
        gw += dw * dw
        gb += db * db
        weight -= 0.3 * dw / np.sqrt(gw)
        bias -= 0.3 * db / np.sqrt(gb)
    return weight, bias


def piece(have: set[bytes], pairs: dict[str, list[set[bytes]]]) -> bool:
    """Whether word pairs are half of a template's, or half of them a template's: no evidence of the unknown class."""
    for t in (t for ts in pairs.values() for t in ts):
        n = len(have & t)
        if n > 1 and (2 * n >= len(t) or 2 * n >= len(have)):
            return True
    return False


def train(paragraphs: list[str], templates: dict[str, tuple[str, ...]] = TEMPLATES) -> Model:
    """The classifier from templates and a sample of paragraphs."""
    rng = np.random.RandomState(SEED)
    families = [UNKNOWN, *sorted(templates)]
    parts = {f: [words_of(t.encode()) for t in templates[f]] for f in families[1:]}
    pairs = {f: [_pairs(w) for w in ws] for f, ws in parts.items()}
    sample = [words_of(p.encode()) for p in paragraphs if p]
    filler = [w for ws in sample[:500] for w in ws] or [b"the", b"of", b"a"]
    texts, labels = [], []
    for ws in sample:
        have = _pairs(ws)
        best = max(((len(have & t) / len(t), len(t), f) for f in pairs for t in pairs[f] if t), default=(0.0, 0, UNKNOWN))
        if best[0] < 0.9 and piece(have, pairs):
            continue
        texts.append(ws)
        labels.append(families.index(best[2]) if best[0] >= 0.9 else 0)
    for f in families[1:]:
        for ws in parts[f]:
            for v in range(VARIANTS):
                keep = [w for w in ws if v == 0 or rng.random_sample() > 0.08]
                extra = [filler[i] for i in rng.randint(0, len(filler), rng.randint(0, 8))] if v else []
                at = rng.randint(0, len(extra) + 1)
                texts.append(extra[:at] + keep + extra[at:])
                labels.append(families.index(f))
    # short mentions of a template's words are no licence
    for ws in [w for f in families[1:] for w in parts[f]]:
        for _ in range(6):
            cut = [ws[i] for i in sorted(rng.randint(0, len(ws), max(1, len(ws) // 4)))]
            texts.append([filler[i] for i in rng.randint(0, len(filler), 12)] + cut)
            labels.append(0)
    own = {g for f in parts for ws in parts[f] for g in grams_of(ws)}
    common = Counter(g for ws in sample for g in set(ws))
    features = {g: i for i, g in enumerate(sorted(own | {g for g, _ in sorted(common.items(), key=lambda x: (-x[1], x[0]))[:COMMON]}))}
    labels = np.array(labels)
    rows = [sorted({features[g] for g in grams_of(ws) if g in features}) for ws in texts]
    held = rng.random_sample(len(rows)) < 0.2
    pick = lambda m: [r for r, x in zip(rows, m) if x]
    weight, bias = fit(pick(~held), labels[~held], len(features), len(families))
    z, y = scores(pick(held), weight, bias), labels[held]
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    loss = [-np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid] if len(y) else [0.0]
    mine = np.array([g in own for g in features], bool)
    return Model(families, features, mine, weight, bias, float(grid[int(np.argmin(loss))]), pairs)


def train_on(docs: DataFrame, paragraphs: int = SAMPLE_PARAGRAPHS) -> Model:
    """The classifier from a sample of the paragraphs of ``docs``, at most ``paragraphs`` of them.

    Rows are chosen by a hash of their text; short paragraphs and ones with
    "licen" or "copyright" in them are as welcome as others.
    """
    rows = docs.select(F.col("text").cast("string").alias("text"), row_key("text").alias("k")).filter(F.col("text").isNotNull())
    n = rows.count()
    chosen = rows.filter(F.pmod("k", F.lit(1 << 30)) <= int(min(1.0, paragraphs / max(1, n)) * (1 << 30)))
    lines = chosen.select(F.explode(F.split("text", "\n")).alias("p")).filter(F.trim("p") != "")
    picked = lines.select("p", row_key("p").alias("k")).distinct().orderBy("k", "p").limit(paragraphs)
    return train([r["p"] for r in picked.select("p").collect()])


def scan(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row of ``docs`` (see ``with_rows``) with ``licences``: (family, probability, similarity, confirmed) by passage.

    Null and empty texts have none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        kind = pa.list_(pa.struct([("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64()), ("confirmed", pa.bool_())]))
        held = shared.value
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            for i, j in row_chunks(offsets, SCAN_BYTES):
                data, cut = raw[offsets[i]:offsets[j]].tobytes(), (offsets[i:j + 1] - offsets[i]).tolist()
                found = [[dict(zip(("family", "probability", "similarity", "confirmed"), x)) for x in xs]
                         for xs in held.scan([data[s:e] for s, e in zip(cut, cut[1:])])]
                yield batch, i, j, [pa.array(found, kind)]

    return with_rows(docs, text, run, "licences array<struct<family:string,probability:double,similarity:double,confirmed:boolean>>")


def licences_of(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, licence (family of the most probable confirmed passage, else null), probability,
    similarity, n_named (passages that name one) and n_confirmed."""
    got = scan(docs.select("doc_id", "text"), train_on(docs))
    good = F.filter("licences", lambda x: x["confirmed"])
    best = F.array_max(F.transform(good, lambda x: F.struct(x["probability"].alias("p"), x["similarity"].alias("s"), x["family"].alias("f"))))
    return got.select(F.col("payload.doc_id").alias("doc_id"), best["f"].alias("licence"), F.round(best["p"], 6).alias("probability"),
                      F.round(best["s"], 6).alias("similarity"), F.size("licences").alias("n_named"), F.size(good).alias("n_confirmed"))
