"""Queries without SQL whose results must cover their whole tables."""

from postloom.plans import catalog


def _documents(spark, folder, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")


def test_diverse_places_every_document(spark, tmp_path):
    texts = [(i, f"w{i} x", "en" if i < 230 else None, "s", 1000 - i) for i in range(240)]
    _documents(spark, tmp_path, texts)
    got = catalog.QUERIES["h11_diverse"](spark, str(tmp_path)).collect()
    places = {lang: sorted(r["place"] for r in got if r["lang"] == lang) for lang in ("en", None)}
    assert places == {"en": list(range(1, 231)), None: list(range(1, 11))}
    rest = sorted((r["place"], r["doc_id"]) for r in got if r["lang"] == "en" and r["place"] > 200)
    assert rest == [(i + 1, i) for i in range(200, 230)]


def test_snippets_of_every_document(spark, tmp_path):
    _documents(spark, tmp_path, [(1, "see the fox", "en", "s", 11), (2, "das the Haus", "de", "s", 12), (3, "the end", None, "s", 7), (4, None, "fr", "s", None)])
    got = {r["doc_id"]: r["snippet"] for r in catalog.QUERIES["x08_snippets"](spark, str(tmp_path)).collect()}
    assert got == {1: "see [[the]] fox", 2: "das [[the]] Haus", 3: "[[the]] end", 4: None}
