"""Nulls in any column, empty tables, repeated rows, very long texts and extra columns with clashing names."""

import pytest

import corpus_pipeline
from linkquarry.llm import decontaminate, linededup, lm, minhash, packing, queries, repair, secrets, toxicity, warc, winnow

LABELS, BENCHMARK, PAGES = "doc_id long, quality int, toxic int", "item_id long, text string", "page_id long, url string, html string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, band long, key string, part int, start long, line string, root long, a long, b long, _1 string"
LONG = ("very long words " * 40_000) + "end"
ROWS = [(1, "one two three", *[None] * 13), (1, "one two three", *[None] * 13), (None, "one two three", *[None] * 13), (2, None, *[None] * 13), (3, "", *[None] * 13), (None, None, *[None] * 13), (4, LONG, *[None] * 13)]


def tables(spark):
    return spark.createDataFrame(ROWS, DOCS), spark.createDataFrame([(1, None, 1), (None, 1, 1), (2, 1, None), (3, 1, 0), (3, 1, 1)], LABELS), spark.createDataFrame([(None, "one two three"), (1, None)], BENCHMARK)


OPERATORS = {
    "packing": lambda d, la, be: packing.pack(d),
    "minhash": lambda d, la, be: minhash.near_duplicates(d),
    "toxicity": lambda d, la, be: toxicity.toxicity(d, la),
    "winnow": lambda d, la, be: winnow.edited_fingerprints(d),
    "secrets": lambda d, la, be: secrets.scan(d),
    "repair": lambda d, la, be: repair.token_output(d),
    "linededup": lambda d, la, be: linededup.deduplicated_lines(d),
    "lm": lambda d, la, be: lm.language_model_scores(d),
    "decontaminate": lambda d, la, be: decontaminate.overlaps(d, be),
}
STAGES = {
    "without_toxic": lambda d, la, be: toxicity.without_toxic(d, la),
    "clean": lambda d, la, be: linededup.clean(d),
    "deduplicate": lambda d, la, be: minhash.deduplicate(d),
    "decontaminated": lambda d, la, be: decontaminate.decontaminate(d, be),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    d, la, be = tables(spark)
    rows = OPERATORS[name](d, la, be).collect()
    ids = sorted(-1 if r.doc_id is None else r.doc_id for r in rows)
    if name == "decontaminate":
        assert ids == [-1, 1, 1]
    elif name == "packing":
        assert set(ids) == {-1, 1, 2, 3, 4}
    else:
        assert ids == [-1, -1, 1, 1, 2, 3, 4]


@pytest.mark.parametrize("name", [*OPERATORS, *STAGES])
def test_empty_tables(spark, name):
    d, la, be = tables(spark)
    assert (OPERATORS | STAGES)[name](d.limit(0), la.limit(0), be.limit(0)).collect() == []


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns(spark, name):
    d, la, be = tables(spark)
    out = STAGES[name](d, la, be)
    assert out.schema.fieldNames() == d.schema.fieldNames() and out.count() > 0


def test_equal_rows_share_a_component(spark):
    d, *_ = tables(spark)
    rows = [(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(d).collect() if r.n_shingles == 1]
    assert sorted(rows, key=str) == [(1, 1, True), (1, 1, True), (None, None, True)]


def test_odd_pages(spark):
    pages = spark.createDataFrame([(None, None, None), (1, "x", "y" * 2000), (1, "x", "y" * 2000), (None, "x", "y" * 2000), (0, "x\r\nWARC-Type: fake", "y" * 2000)], PAGES)
    rows = warc.archive(pages).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in rows) == [("0", "revisit", 1), ("1", "response", None), ("1", "response", None), ("None", "response", None), ("None", "revisit", 1)]
    assert warc.archive(pages.limit(0)).collect() == []


def test_queries_are_registered():
    assert {n.split("_")[0] for n in queries.QUERIES if n.startswith("op")} == {f"op{k}" for k in range(1, 11)} and set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_pipeline(spark, tmp_path):
    import random

    from linkquarry.llm import tokens

    rng = random.Random(3)
    text = lambda n: "\n".join(" ".join(f"w{rng.randrange(5000)}" for _ in range(30)) for _ in range(n))
    base, passage = text(4), " ".join(f"b{k}" for k in range(40))
    near = base.replace("w1", "v1", 1)
    texts = [text(3) for _ in range(20)] + [base, f"{base} more", near, f"{text(1)}\n{passage}\n{text(1)}", "you idiot moron scum " * 5 + text(2)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i == 24)) for i in range(25)], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, passage)], BENCHMARK).write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).cache()
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert kept["toxicity"] == kept["line_dedup"] and len(kept["toxicity"]) >= 24 - 1
    assert 23 in kept["near_duplicates"] and 23 not in kept["decontamination"]
    assert kept["packing"] == kept["decontamination"]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.agg({"length": "sum"}).first()[0] == docs.agg({"length": "sum"}).first()[0]
    assert tokens.default_tokenizer()
