"""Language identification by prediction by partial matching (PPM).

Training counts, per language, which byte follows which context of up to
``ORDER`` bytes.  The statistics are then frozen.  Coding a byte starts at the
longest context seen in training: a context with N followers, T of them
distinct, gives a follower seen n times the share n / (N + T) and the escape
T / (N + T); after an escape the next shorter context codes the byte, and past
the empty context all 256 bytes are equally likely (method C, without
exclusions).  A text's code length under a language is the sum over its bytes,
in fixed point, so it does not depend on the order of addition; the language
with the shortest code wins, ties by name.

Training reads a bounded sample of labelled rows (``SAMPLE_ROWS`` different
texts of each of the ``LANGUAGES`` languages with most different texts, chosen
by a hash of the text, whole texts); copies count once, so a language made of
copies is learned from all its texts.  Prediction reads every row once where
Spark reads it, with no shuffle.  The model is broadcast: its size is bounded
by the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import original, row_chunks, row_key, text_buffer, with_rows

#: Longest context in bytes.
ORDER = 4
#: Different labelled texts per language that the statistics are learned from.
SAMPLE_ROWS = 400
#: Languages that are learned: those with most different texts, ties by name.
LANGUAGES = 256
#: Bits a byte costs without any model; a text that no language codes in fewer is in none of them.
PLAIN_BITS = 8.0
#: Code lengths are kept in this many parts of a bit.
PARTS = 1024
UNDETERMINED = "und"
MIX = np.uint64(0x9E3779B97F4A7C15)


class Lookup:
    """Places of known keys, by hashing; numpy arrays in, numpy arrays out (-1: unknown)."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.levels: list[tuple[np.uint64, np.uint64, np.ndarray]] = []
        left = np.arange(len(keys), dtype=np.int32)
        mult = MIX
        while len(left):
            bits = max(4, int(len(left)).bit_length() + 3)
            shift = np.uint64(64 - bits)
            slot = (keys[left] * mult) >> shift
            table = np.full(1 << bits, -1, np.int32)
            table[slot] = left
            self.levels.append((mult, shift, table))
            left = left[table[slot] != left]
            mult = np.uint64((int(mult) * int(MIX) + 2) & (1 << 64) - 1)

    def find(self, codes: np.ndarray) -> np.ndarray:
        out = np.full(len(codes), -1, np.int32)
        if not len(self.keys):
            return out
        ask = None
        for mult, shift, table in self.levels:
            c = codes if ask is None else codes[ask]
            at = table[(c * mult) >> shift]
            good = (at >= 0) & (self.keys[at] == c)
            if ask is None:
                out = np.where(good, at, np.int32(-1))
                ask = np.flatnonzero(~good)
            else:
                out[ask[good]] = at[good]
                ask = ask[~good]
            if not len(ask):
                break
        return out


@dataclass
class Model:
    """Frozen statistics: code lengths of seen strings, escapes of seen contexts, per language."""

    languages: list[str]
    grams: list[np.ndarray] = field(default_factory=list)  # by order: codes of context and follower
    cost: list[np.ndarray] = field(default_factory=list)  # rows as in grams; a column per language
    contexts: list[np.ndarray] = field(default_factory=list)  # by order: codes of the contexts
    escape: list[np.ndarray] = field(default_factory=list)  # rows as in contexts

    def __post_init__(self):
        self.lookups: list[Lookup] | None = None

    def code_lengths(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text under each language, in ``1 / PARTS`` bits."""
        n, width = len(offsets) - 1, len(self.languages)
        total = np.zeros((n, width), np.int64)
        if not len(raw) or not width:
            return total
        if self.lookups is None:
            self.lookups = [Lookup(g) for g in self.grams]
            self.context_lookups = [Lookup(c) for c in self.contexts]
        order = len(self.grams) - 1
        codes = _codes(raw, offsets, order)
        cost = np.zeros((len(raw), width), np.int32)
        at = self.lookups[order].find(codes)
        known = at >= 0
        cost[:] = self.cost[order][np.where(known, at, 0)]
        rest = np.flatnonzero(~known)
        cost[rest] = 0
        for o in range(order - 1, -2, -1):
            if not len(rest):
                break
            # the contexts of o + 1 bytes did not know the byte: escapes, where they are known at all
            c = self.context_lookups[o + 1].find(codes[rest] >> np.uint64(8) & _mask(o + 1))
            cost[rest[c >= 0]] += self.escape[o + 1][c[c >= 0]]
            if o < 0:
                cost[rest] += 8 * PARTS
                break
            at = self.lookups[o].find(codes[rest] & _mask(o + 1))
            known = at >= 0
            cost[rest[known]] += self.cost[o][at[known]]
            rest = rest[~known]
        filled = np.flatnonzero(offsets[1:] > offsets[:-1])
        total[filled] = np.add.reduceat(cost, offsets[filled], axis=0, dtype=np.int64)
        return total


def _mask(n_bytes: int) -> np.uint64:
    return np.uint64((1 << 8 * n_bytes) - 1)


def _codes(raw: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """Each byte with the ``order`` bytes before it; before a text's start stand zero bytes."""
    codes = raw.astype(np.uint64)
    starts = np.repeat(offsets[:-1], np.diff(offsets))
    place = np.arange(len(raw)) - starts
    for back in range(1, order + 1):
        before = np.zeros(len(raw), np.uint64)
        before[back:] = raw[:-back] if back < len(raw) else before[back:]
        before[place < back] = 0
        codes |= before << np.uint64(8 * back)
    return codes


def train(labelled: DataFrame, rows: int = SAMPLE_ROWS, order: int = ORDER) -> Model:
    """Statistics of up to ``rows`` different texts per language of ``labelled`` (lang, text).

    Rows without language or text are not used.  The counts are summed by
    Spark; what reaches the driver is the model, bounded by the sample.
    """
    usable = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()) \
        .select("lang", "text", row_key("text", "lang").alias("k"))
    there = {r["lang"]: r["n"] for r in usable.select("lang", "k").distinct().groupBy("lang")
             .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    languages = sorted(there)
    if not languages:
        return Model([])
    # a hash threshold leaves about 1.5 times the texts wanted (all, where they are few), the rank cuts that to the bound
    share = F.create_map(*[x for lang in languages for x in (
        F.lit(lang), F.lit(int(min(1.0, (1.5 * rows + 50) / there[lang]) * (1 << 30)) + 1))])
    near = usable.filter(F.pmod("k", F.lit(1 << 30)) <= share[F.col("lang")]).groupBy("lang", "k").agg(F.min("text").alias("text"))
    sample = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("k", "text"))).filter(F.col("r") <= rows)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            raw, offsets = text_buffer(batch.column(1))
            codes = _codes(raw, offsets, order)
            of = np.repeat(langs, np.diff(offsets))
            for lang in set(langs):
                mine = codes[of == lang]
                for o in range(order + 1):
                    g, n = np.unique(mine & _mask(o + 1), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(g), pa.string()), pa.array(np.full(len(g), o, np.int32)),
                         pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "o", "g", "n"])

    counted = sample.select("lang", "text").mapInArrow(grams, "lang string, o int, g long, n long") \
        .groupBy("lang", "o", "g").agg(F.sum("n").alias("n"))
    return build(counted.toArrow(), languages, order)


def build(counted: pa.Table, languages: list[str], order: int) -> Model:
    """The model from the counts (lang, o, g, n) of strings of o + 1 bytes."""
    lang = np.array([languages.index(x) for x in counted.column("lang").to_pylist()], np.int64)
    o_of, g_of, n_of = (counted.column(c).to_numpy() for c in ("o", "g", "n"))
    model, width = Model(languages), len(languages)
    for o in range(order + 1):
        pick = o_of == o
        codes = g_of[pick].astype(np.uint64)
        grams, where = np.unique(codes, return_inverse=True)
        n = np.zeros((len(grams), width))
        n[where, lang[pick]] = n_of[pick]
        context = grams >> np.uint64(8)
        contexts, of = np.unique(context, return_inverse=True)
        total, kinds = np.zeros((len(contexts), width)), np.zeros((len(contexts), width))
        np.add.at(total, of, n)
        np.add.at(kinds, of, n > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            # a context that a language never met costs it nothing
            escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
            coded = -np.log2(n / (total + kinds)[of])
        escape = np.rint(escape * PARTS).astype(np.int32)
        if o:
            shorter = model.cost[o - 1][Lookup(model.grams[o - 1]).find(grams & _mask(o))]
        else:
            shorter = np.full((len(grams), width), 8 * PARTS, np.int32)
        model.grams.append(grams)
        model.cost.append(np.where(n > 0, np.rint(np.where(n > 0, coded, 0) * PARTS), escape[of] + shorter).astype(np.int32))
        model.contexts.append(contexts)
        model.escape.append(escape)
    return model


def predict(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Every row of ``docs`` (see ``with_rows``) with ``lang_pred``, ``score`` and ``bits_per_byte``.

    ``score`` is the winner's share of 2 to the minus code length over all
    languages.  A null text, one without a letter (so an empty one too), or a
    model without languages gives ``und`` and score 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        import regex

        letter = regex.compile(r"\p{L}")
        held = shared.value
        for batch in batches:
            col = batch.column(1)
            raw, offsets = text_buffer(col)
            for i, j in row_chunks(offsets, 1 << 20):
                part = offsets[i:j + 1]
                bits = held.code_lengths(raw[part[0]:part[-1]], part - part[0]) / PARTS
                texts = col.slice(i, j - i).to_pylist()
                lang, score, rate = [], [], []
                for k, t in enumerate(texts):
                    if not t or not held.languages or not letter.search(t):
                        lang.append(UNDETERMINED)
                        score.append(0.0)
                        rate.append(None)
                        continue
                    best = int(np.argmin(bits[k]))
                    lang.append(held.languages[best])
                    score.append(float(1.0 / np.exp2(np.maximum(bits[k][best] - bits[k], -1000)).sum()))
                    rate.append(float(bits[k][best] / (part[k + 1] - part[k])))
                yield batch, i, j, [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())]

    return with_rows(docs, text, run, "lang_pred string, score double, bits_per_byte double", keep_text)


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def languages_of(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; learned from the rows that are not held out.

    A row without id is neither learned from nor held out.
    """
    model = train(docs.filter(fold() != 2).select("lang", "text"))
    got = predict(docs.select("doc_id", "text"), model)
    return got.select(F.col("payload.doc_id").alias("doc_id"),
                      F.coalesce(F.crc32(F.col("payload.doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)).alias("held_out"),
                      "lang_pred", "score", "bits_per_byte")


def identified(docs: DataFrame, plain_bits: float = PLAIN_BITS) -> DataFrame:
    """The rows of ``docs`` that are in a learned language; where ``lang`` is null it is filled in with that language.

    A row goes if its text is null or has no letter, or if even the best
    language codes it in ``plain_bits`` a byte or more: its bytes without any
    model are no longer.  A ``lang`` that is given stays.
    """
    model = train(docs.filter(fold() != 2).select("lang", "text"))
    got = predict(docs, model, keep_text=True)
    told = got.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("bits_per_byte") < plain_bits))
    return told.select(*[F.coalesce("payload.lang", "lang_pred").alias(c) if c == "lang" else col
                         for c, col in zip(docs.columns, original(docs))])
