"""Quality rules of texts, and host-level verdicts from their shrunk failure rates.

Each text's counts are worked out where Spark reads it.  Failures are summed
by host (``source``), shrunk with a beta prior fitted to all hosts, and the
hosts' verdicts join back to the documents.  The counts are checkpointed: they
are a few numbers a document, and the texts are read once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .common import row_chunks, split_join, text_buffer
from .shrinkage import PRIOR_SQL, lower_bound, prior, shrunk

# Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
#: A host goes if its failure rate lies above this with confidence (``Z`` posterior standard deviations).
HOST_LIMIT = 0.5
Z = 1.645

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in strings of ``window`` words that occur twice or more, the first occurrence included.

    Strings of one, two, four, ... words are numbered by sorting the numbers of
    their halves, so equality is exact.  Few texts repeat four words.
    """
    n = len(words)
    if n <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    size = 1
    while size < window:
        step = min(size, window - size)
        kinds, ids = np.unique(ids[:-step] * (int(ids.max()) + 1) + ids[step:], return_inverse=True)
        if len(kinds) == len(ids):
            return 0
        size += step
    twice = np.bincount(ids)[ids] > 1
    covered = np.zeros(n + 1, np.int64)
    covered[:len(twice)] += twice
    covered[window:window + len(twice)] -= twice
    return int((np.cumsum(covered) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split(b"\n")
    if len(lines) == 1 or len(set(lines)) == len(lines):
        return 0
    kept = [x for x in lines if x.strip()]
    return len(kept) - len(set(kept))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, host and the counts of every row; a null text has no words."""
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column(2))
            for i, j in row_chunks(offsets):
                part = offsets[i:j + 1] - offsets[i]
                some = raw[offsets[i]:offsets[j]]
                chars = np.r_[0, np.cumsum(((some & 0xC0) != 0x80) & ~_SPACES[some])]
                symbols = np.r_[0, np.cumsum(_IS_SYMBOL[some])]
                data, cut = some.tobytes(), part.tolist()
                n, lines, repeats = [], [], []
                for s, e in zip(cut, cut[1:]):
                    text = data[s:e]
                    words = text.split()
                    n.append(len(words))
                    lines.append(duplicate_lines(text))
                    repeats.append(repeated_words(words))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n, pa.int64()),
                     pa.array(chars[part[1:]] - chars[part[:-1]], pa.int64()), pa.array(symbols[part[1:]] - symbols[part[:-1]], pa.int64()),
                     pa.array(lines, pa.int64()), pa.array(repeats, pa.int64())], names=["doc_id", "host", *counts])

    rows = docs.select("doc_id", F.col("source").cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, host string, " + ", ".join(f"{c} long" for c in counts))


def judge(docs: DataFrame, limit: float = HOST_LIMIT, z: float = Z) -> DataFrame:
    """Per row of ``docs``: its counts, ``base_failed``, the host's shrunk failure rate and ``kept``.

    A row is kept if it passes the base rules and its host's failure rate is
    not above ``limit`` with confidence.  Rows without host are judged by the
    base rules alone (rate null).  Repeated rows each count.
    """
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    rows = checkpoint(measure(docs).withColumn("base_failed", failed))
    hosts = checkpoint(rows.filter(F.col("host").isNotNull()).groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("f")))
    rate, strength = prior(hosts, "n", "f")
    verdicts = hosts.select("host", F.round(shrunk(F.col("n"), F.col("f"), F.lit(rate), strength), 6).alias("host_rate"),
                            (lower_bound(F.col("n"), F.col("f"), F.lit(rate), strength, z) > limit).alias("host_out"))
    out = split_join(rows, verdicts, ["host"], "left")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_out", F.lit(False))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rate")


SQL = f"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws
    FROM documents
), windows AS (
    SELECT r, i, list_slice(ws, i, i + 7) AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM docs)
), twice AS (
    SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM windows) WHERE c > 1
), covered AS (
    SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 8)) AS k) GROUP BY r
), lines AS (
    SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM docs)
    WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY r
), counts AS (
    SELECT doc_id, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
           (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
           coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
    FROM docs LEFT JOIN lines USING (r) LEFT JOIN covered USING (r)
), judged AS (
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts
), hosts AS (
    SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM judged WHERE source IS NOT NULL GROUP BY source
), prior AS ({PRIOR_SQL.format(groups="hosts")}
), verdicts AS (
    SELECT source, m AS host_rate, m - {Z} * sqrt(m * (1 - m) / (strength + n + 1)) > {HOST_LIMIT} AS host_out
    FROM (SELECT *, (strength * rate + f) / (strength + n) AS m FROM hosts, prior)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(host_out, false) AS kept, round(host_rate, 6) AS host_rate
FROM judged LEFT JOIN verdicts USING (source)
"""
