"""Small inputs that every operator of documents must take."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id string, y int, h string"


def documents(spark, texts, ids=None):
    """Documents with extra columns whose names clash with those that operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, "c", 7, "h") for i, t in zip(ids, texts, strict=True)], SCHEMA)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r))
