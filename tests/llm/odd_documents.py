"""Documents tables for tests: odd texts, and columns whose names an operator might use itself."""

SF_SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, ids=None, lang="en", source="s", parts=3):
    from pyspark.sql import functions as F

    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, lang, source, None if t is None else len(t)) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, DOCS).withColumns(
        {c: F.lit(7) for c in ("payload", "rk", "fp", "h", "leaks", "ids", "host", "k", "part")}).repartition(parts)


#: Texts that every operator must stand: null, empty, blank, odd characters, very long.
ODD = [None, "", " ", "\n\n", "a", "é́ 　 x", "\x1c\x1d \x85", "\U0001f642" * 50, "x" * 200_000,
       "the " * 30_000, "12 34", "-- !!", "same text here", "same text here"]
