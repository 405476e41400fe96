from collections import Counter

import pytest
from pyspark.sql import functions as F

from linkquarry.functions import text
from linkquarry.operators import blocking, decision, features, learning, overlap, profile, tfidf, validate
from linkquarry.plans import catalog, cli, pipeline
from linkquarry.sources import tables

RECORD = "entity_id string, business_name string, business_address string, country string, source string"


def records(spark, rows):
    return spark.createDataFrame(rows, RECORD)


@pytest.fixture(scope="module")
def world(spark):
    s1 = records(spark, [("S1-1", "Apollo Clinic", "12 Main St, Springfield", "US", "S1"), ("S1-2", "Étoile Bleue SARL", "5 Rue X, Paris", "FRANCE", "S1"), ("S1-3", "Zeta", None, "US", "S1"), ("S1-4", "No Country", "1 A St", "", "S1")])
    pool = records(spark, [("S2-1", "Apollo Clinic", "12 Main Street, Springfield", "US", "S2"), ("S2-2", "Apollo Clinic", "12 Main St", "FRANCE", "S2"), ("S3-1", "Etoile Bleue", "5 Rue X, Paris", "FRANCE", "S3"), ("S3-2", "Apolo Clinics", "99 Elm", "US", "S3")])
    return s1, pool


def found(df):
    return {(r.s1_entity_id, r.candidate_entity_id) for r in df.collect()}


def test_candidates_stay_within_a_country(world):
    s1, pool = (blocking.prepare(x) for x in world)
    out = blocking.candidates(s1, pool)
    assert found(out) == {("S1-1", "S2-1"), ("S1-1", "S3-2"), ("S1-2", "S3-1")}
    best = {(r.s1_entity_id, r.candidate_entity_id): (r.priority, r["rank"], r.candidate_source) for r in out.collect()}
    assert best["S1-1", "S2-1"] == (1, 1, "S2") and best["S1-2", "S3-1"][2] == "S3"


def test_bucket_beyond_the_cap_gives_nothing(spark):
    s1 = blocking.prepare(records(spark, [("S1-1", "Acme", "", "US", "S1")]))
    rows = [(f"S2-{i}", "Acme", "", "US", "S2") for i in range(4)]
    assert len(found(blocking.by_exact_name(s1, blocking.prepare(records(spark, rows[:3])), 3))) == 3
    assert found(blocking.by_exact_name(s1, blocking.prepare(records(spark, rows)), 3)) == set()


def test_budget(spark):
    s1 = blocking.prepare(records(spark, [("S1-1", "Acme Widgets", "1 A St", "US", "S1")]))
    pool = blocking.prepare(records(spark, [(f"S2-{i:02}", f"Acme Widgets {i}", "1 A St", "US", "S2") for i in range(15)]))
    out = blocking.candidates(s1, pool, blocking.Blocking(budget=5)).collect()
    assert sorted(r["rank"] for r in out) == [1, 2, 3, 4, 5]


def test_address_paths_are_weighted(spark):
    s1 = blocking.prepare(records(spark, [("S1-1", "West Clinic", "1795 Westchester Dr", "US", "S1"), ("S1-2", "None", "", "US", "S1")]))
    pool = blocking.prepare(records(spark, [("S2-1", "West Clinic", "1795 Westchester Drive", "US", "S2"), ("S2-2", "Other", "1795 Oak", "US", "S2"), ("S2-3", "West", None, "US", "S2")]))
    out = {(r.s1_entity_id, r.candidate_entity_id): r.score for r in blocking.by_address(s1, pool).collect()}
    assert out == {("S1-1", "S2-1"): 3 + 2 * 3 + 1, ("S1-1", "S2-2"): 2 + 1}


def test_address_tokens_are_dealt_to_a_number_of_tasks_that_stays(spark, world):
    """Few tokens are few bytes, which Spark would put in one task, but can have many pairs."""
    s1, pool = (blocking.prepare(x) for x in world)
    plan = blocking.by_address(s1, pool)._jdf.queryExecution().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 2


def test_token_overlap_applies_least_after_top(spark):
    q = spark.createDataFrame([("q", "a"), ("q", "b")], "query_id string, token string")
    index = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "a")], "candidate_id string, token string")
    assert {(r.candidate_id, r.score) for r in blocking.by_token_overlap(q, index, least=2).collect()} == {("x", 2)}


def test_token_overlap_keeps_the_best_of_every_pair(spark):
    import random

    rng = random.Random(5)
    word = lambda: f"w{min(rng.randrange(40), rng.randrange(40), rng.randrange(40))}"
    make = lambda n, p: {f"{p}{i}": {word() for _ in range(rng.randrange(1, 12))} for i in range(n)}
    asked, held = make(60, "q"), make(400, "c")
    asked |= {f"r{i}": asked["q1"] for i in range(5)}
    held |= {f"d{i}": held["c7"] for i in range(30)}
    held[None] = held["c7"]
    df = lambda d, name: spark.createDataFrame([(k, w) for k, v in d.items() for w in v] * 2 + [("n", None)], f"{name} string, token string")
    want = set()
    for q, x in asked.items():
        ranked = sorted((-len(x & y), c is not None, c or "", c) for c, y in held.items())
        want |= {(q, c, -s) for s, _, _, c in ranked[:20] if s <= -2}
    out = blocking.by_token_overlap(df(asked, "query_id"), df(held, "candidate_id"), least=2, top=20).collect()
    assert len(out) == len(want) and {tuple(r) for r in out} == want


@pytest.mark.parametrize("first, bits", [(1, 64), (3, 128), (40, 512)])
def test_best_sets_of_a_block(monkeypatch, first, bits):
    import numpy as np

    monkeypatch.setattr(overlap, "FIRST", first)
    monkeypatch.setattr(overlap, "BITS", bits)
    rng = np.random.default_rng(first)
    sets = [np.unique(rng.zipf(1.3, rng.integers(1, 30)).clip(0, 300)) for _ in range(700)]
    block = overlap.Held(np.concatenate(sets), np.array([len(x) for x in sets]))
    for top, least in ((1, 1), (5, 2), (50, 3)):
        for asked in sets[::23] + [np.array([1000])]:
            scores = [len(np.intersect1d(asked, x)) for x in sets]
            want = sorted(i for i in sorted(range(len(sets)), key=lambda i: (-scores[i], i))[:top] if scores[i] >= least)
            at, score = block.best(asked, top, least)
            assert at.tolist() == want and score.tolist() == [scores[i] for i in want]


def test_token_overlap_of_documents_without_a_language(spark, tmp_path):
    spark.createDataFrame([(3, "alpha beta", None), (4, "alpha beta", "en")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [tuple(r) for r in catalog.doc_token_overlap(spark, str(tmp_path)).collect()] == [("S1-3", "S2-4", 2)]


def test_tfidf_grams(spark):
    df = spark.createDataFrame([("a bcd",)], "t string").select(tfidf.grams(F.col("t")).alias("g"))
    assert df.first().g == [" a ", " bc", "bcd", "cd ", " bcd", "bcd "]


def test_tfidf_finds_typos_within_a_country(spark):
    names = ["apollo hospital", "apolo hospital", "zenith bank", "zenit bank", "other thing"]
    pool = spark.createDataFrame([(f"S2-{i}", c, "S2", n) for c in ("A", "B") for i, n in enumerate(names)], "entity_id string, country string, source string, text string").withColumn("entity_id", F.concat("country", "entity_id"))
    s1 = spark.createDataFrame([("S1-1", "A", "S1", "apollo hospital"), ("S1-2", "C", "S1", "apollo hospital")], "entity_id string, country string, source string, text string")
    out = tfidf.similar(s1, pool).orderBy("place").collect()
    assert [r.candidate_entity_id for r in out][:2] == ["AS2-0", "AS2-1"] and out[0].similarity == pytest.approx(1) and all(r.candidate_entity_id[0] == "A" for r in out)


def test_features(spark, world):
    s1, pool = world
    pairs = spark.createDataFrame([("S1-1", "S2-1", "S2"), ("S1-3", "S3-2", "S3")], "s1_entity_id string, candidate_entity_id string, candidate_source string")
    out = {r.s1_entity_id: r.asDict() for r in features.pair_features(pairs, s1, pool).collect()}
    a, b = out["S1-1"], out["S1-3"]
    assert len(a) == 21 and a["name_exact_match"] == a["name_token_jaccard"] == a["name_char_ngram_cosine"] == a["address_house_number_match"] == 1 and a["source_is_s2"] == 1 and a["address_missing"] == 0
    assert b["address_missing"] == 1 and b["address_edit_similarity"] == 0 and b["address_token_jaccard"] == 0 and b["source_is_s3"] == 1 and b["country_match"] == 1
    with pytest.raises(Exception, match="no record"):
        features.pair_features(spark.createDataFrame([("S1-9", "S2-1", "S2")], pairs.schema), s1, pool).collect()
    with pytest.raises(Exception, match="unknown source"):
        features.pair_features(spark.createDataFrame([("S1-1", "S2-1", "S9")], pairs.schema), s1, pool).collect()
    with pytest.raises(ValueError, match="missing"):
        features.model_features(pairs)


def test_labels_shards_and_checks(spark, world):
    s1, pool = world
    pairs = spark.createDataFrame([("S1-1", "S2-1", "S2"), ("S1-1", "S3-2", "S3"), ("S1-2", "S3-1", "S3")], "s1_entity_id string, candidate_entity_id string, candidate_source string")
    truth = spark.createDataFrame([("S1-1", ["S2-1", "S2-9"]), ("S1-2", ["S3-1"]), ("S1-3", [])], "s1_entity_id string, ids array<string>")
    rows = features.training_rows(pairs, s1, pool, truth)
    assert len(rows.columns) == 22 and sorted((r.candidate_entity_id, r.label) for r in rows.collect()) == [("S2-1", 1), ("S3-1", 1), ("S3-2", 0)]
    c = features.shard_checks(rows, s1.filter("entity_id <> 'S1-4'"), truth, 0).first().asDict()
    assert (c["pairs"], c["positive"], c["links"], c["recalled"], c["s1_rows"], c["without_candidates"], c["max_candidates"], c["at_max"]) == (3, 2, 3, 2, 3, 1, 2, 1)
    assert c["bad_feature"] == c["duplicates"] == c["bad_label"] == 0
    one = spark.createDataFrame([("S1-925783039",)], "entity_id string").select(tables.shard_of("entity_id")).first()[0]
    assert one == 1


def test_split_keeps_entities_whole(spark):
    rows = spark.createDataFrame([(f"S1-{i % 10}", i) for i in range(40)], "s1_entity_id string, v int")
    a, b = features.entity_split(rows, 0.3)
    x, y = ({r.s1_entity_id for r in d.collect()} for d in (a, b))
    assert len(y) == 3 and not x & y and a.count() + b.count() == 40


def test_lists_and_thresholds(spark):
    spine = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "s1_entity_id string")
    scored = spark.createDataFrame([("S1-1", "S2-b", 0.99), ("S1-1", "S2-a", 1.0), ("S1-1", "S2-a", 0.2), ("S1-2", "S3-c", 0.4)], "s1_entity_id string, candidate_entity_id string, match_probability double")
    at = lambda t: {r.source1_entity_id: r.matched_entity_ids for r in decision.apply_threshold(scored, t, spine).collect()}
    assert at(1.0) == {"S1-1": "S2-a", "S1-2": "", "S1-3": ""} and at(0.4) == {"S1-1": "S2-a,S2-b", "S1-2": "S3-c", "S1-3": ""}
    with pytest.raises(ValueError):
        at(1.1)
    lists = spark.createDataFrame([("S1-1", "S2-30, S2-30,"), ("S1-1", "S3-1")], "source1_entity_id string, matched_entity_ids string")
    assert {r.source1_entity_id: r.matched_entity_ids for r in decision.match_lists(lists, spine).collect()}["S1-1"] == "S2-30,S3-1"
    with pytest.raises(ValueError, match="no candidates"):
        decision.require_consistent(lists, scored)


def test_metrics(spark):
    spine = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",), ("S1-4",)], "s1_entity_id string")
    pair = "s1_entity_id string, candidate_entity_id string"
    truth = spark.createDataFrame([("S1-1", "a"), ("S1-1", "b"), ("S1-2", "c")], pair)
    pred = spark.createDataFrame([("S1-1", "a"), ("S1-1", "b"), ("S1-1", "x"), ("S1-3", "z")], pair)
    each = decision.per_entity(pred, truth, spine)
    assert {r.s1_entity_id: round(r.f05, 3) for r in each.collect()} == {"S1-1": 0.714, "S1-2": 0, "S1-3": 0, "S1-4": 1}
    m = decision.macro(each).first()
    assert m.macro_f05 == pytest.approx((5 / 7 + 1) / 4) and m.singleton_accuracy == 0.5 and m.multi_match_f05 == pytest.approx(5 / 7)
    scored = pred.withColumn("match_probability", F.when(F.col("candidate_entity_id").isin("a", "b"), 0.8).otherwise(0.3))
    assert decision.best_threshold(scored, truth, spine) == (0.32, pytest.approx(0.75))
    assert len(decision.grid()) == 36 and decision.grid()[-1] == 0.9
    kinds = {(r.s1_entity_id, r.candidate_entity_id): r.kind for r in decision.error_classes(pred, truth, spine.withColumn("country", F.lit("US"))).collect()}
    assert kinds["S1-3", "z"] == "singleton_merge" and kinds["S1-1", "x"] == "false_positive" and kinds["S1-2", "c"] == "false_negative"


def test_rules(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S2-1\nS1-1\tS1-3\nS1-2\tX-1\nbroken\nS1-9\t\n")
    (tmp_path / "c.tsv").write_text("source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-1\nS1-2\t\nS1-3\t\n")
    need = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "entity_id string")
    errors, warnings = validate.validate(spark, str(tmp_path / "m.tsv"), str(tmp_path / "c.tsv"), need, spark.createDataFrame([("S2-1",)], "entity_id string"))
    found = {e.split(": ")[1] for e in errors}
    assert found == {"malformed_row", "duplicate_row", "duplicate_in_list", "self_match", "wrong_prefix", "missing_required", "extra_entity"} and warnings
    (tmp_path / "bad.tsv").write_text("source1_entity_id,matched_entity_ids\n")
    assert "comma" in validate.validate(spark, str(tmp_path / "bad.tsv"), None, need)[0][0]


def test_whole_flow(spark, tmp_path):
    from linkquarry.operators.learning import Boosting

    def write(name, rows, header="entity_id\tbusiness_name\tbusiness_address\tcountry"):
        (tmp_path / f"train_{name}.tsv").write_text("\n".join([header, *("\t".join(r) for r in rows)]) + "\n")

    write("source1", [(f"S1-{i}", f"Firm{i} Works", f"{i} Main St", "US") for i in range(40)])
    write("source2", [(f"S2-{i}", f"Firm{i} Works" if i % 2 else f"Firm{i} Worx", f"{i} Main Street", "us") for i in range(30)])
    write("source3", [(f"S3-{i}", f"Shop{i}", f"{i} Main St", "US") for i in range(30)])
    write("ground_truth", [(f"S1-{i}", f"S2-{i}" if i < 30 else "") for i in range(40)], "source1_entity_id\tmatched_entity_ids")
    paths = pipeline.Paths(str(tmp_path))
    how = blocking.Blocking(budget=10, tfidf=False)
    model, threshold, score = pipeline.train(spark, paths, str(tmp_path / "model"), how, Boosting(trees=5, depth=3))
    assert score > 0.8
    out = pipeline.run(spark, paths, str(tmp_path / "out"), str(tmp_path / "model"), threshold, how)
    assert out.errors == [] and out.matches.count() == 40
    stats = pipeline.training_shard(spark, paths, 0, str(tmp_path / "shards"), how)
    again = pipeline.training_shard(spark, paths, 0, str(tmp_path / "shards"), how)
    assert stats["pairs"] == again["pairs"] > 0 and stats["links"] == stats["recalled"]
    assert cli.main(["validate", str(tmp_path / "out/matching_results.tsv"), paths.of("source1"), "--candidates", str(tmp_path / "out/candidate_pairs.tsv")], spark) == 0
    with pytest.raises(FileNotFoundError):
        pipeline.run(spark, pipeline.Paths(str(tmp_path / "nowhere")))
    with pytest.raises(TypeError):
        learning.load_model(spark, 5)
    assert tables.inspect(spark, paths.of("source1")).first().delimiter == "tab"


def test_standardize(spark):
    df = spark.createDataFrame([(" a ", None, "us ")], "ID string, Company_Name string, CNTRY string")
    assert tuple(tables.standardize(df, "S2").first()) == ("a", "", "", "US", "S2")


def test_truth(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1, S3-2\nS1-2\t\n")
    t = tables.read_truth(spark, str(tmp_path / "t.tsv"))
    assert {r.s1_entity_id: r.ids for r in t.collect()} == {"S1-1": ["S2-1", "S3-2"], "S1-2": []} and tables.read_truth(spark, str(tmp_path / "t.tsv"), singletons=False).count() == 1


def test_percentiles_are_nearest_rank(spark):
    df = spark.createDataFrame([("x" * i,) for i in range(1, 101)], "t string")
    assert {r.percentile: r.length for r in profile.length_percentiles(df, "t").collect()} == {p: p for p in profile.PERCENTILES}


def test_stream(spark, tmp_path, world):
    from linkquarry.streaming.blocking import candidate_stream

    s1, pool = world
    s1.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(s1.schema).parquet(str(tmp_path / "in"))
    candidate_stream(stream, pool, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert found(spark.read.parquet(str(tmp_path / "out"))) == {("S1-1", "S2-1"), ("S1-1", "S3-2"), ("S1-2", "S3-1")}


PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int"


def test_registered_candidates_have_the_tfidf_channel(spark, tmp_path):
    # neither has an address; names differ in their prefix and in all tokens
    parts = [(33, "goldensilverware", "Brand#1", "TIN", 1), (22, "xgoldensilverware", "Brand#2", "TIN", 2), (44, "plum", "Brand#3", "TIN", 3)]
    spark.createDataFrame(parts, PART).write.parquet(f"{tmp_path}/part.parquet")
    rows = catalog.QUERIES["candidates"](spark, str(tmp_path)).collect()
    assert [(r.s1_entity_id, r.candidate_entity_id, r.priority, r.rank) for r in rows] == [("S1-33", "S2-22", 5, 1)]


def test_registered_address_tokens_keep_buckets_up_to_the_operator_s_cap(spark, tmp_path):
    parts = [(k, f"n{k}", "Brand#1", "TIN", 1000 + k) for k in range(1, 451)]
    spark.createDataFrame(parts, PART).write.parquet(f"{tmp_path}/part.parquet")
    rows = catalog.QUERIES["block_address_tokens"](spark, str(tmp_path)).groupBy("s1_entity_id").count().collect()
    assert {r.s1_entity_id for r in rows} == {f"S1-{k}" for k in range(3, 451, 3) if k % 11} and all(r["count"] == 100 for r in rows)


def test_registered_scores_are_of_the_operator_s_own_model(spark, tmp_path, monkeypatch):
    class Asked(Exception):
        pass

    def train(training, validation=None, how=learning.Boosting(), path=None):
        raise Asked(how, validation is not None)

    parts = [(k, f"n{k // 3}", "Brand#1", "TIN", k) for k in range(1, 40)]
    spark.createDataFrame(parts, PART).write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(learning, "train", train)
    with pytest.raises(Asked) as asked:
        catalog.QUERIES["gbt_score"](spark, str(tmp_path))
    assert asked.value.args == (learning.Boosting(), True)


def test_linked_by_keys_are_the_pairs_of_all_records(spark):
    names = ["Banana Bananas", "banana", "A", "", "Mississippi & Co", "aaaa aaa"]
    rows = [(f"S{1 + i % 3}-{i}", names[i % 6 if i % 4 else 0], f"{i % 5} aa st, aaa {i % 2}" if i % 7 else "", "US", f"S{1 + i % 3}", [None, "k", "l"][i * 7 % 11 % 3]) for i in range(60)]
    df = spark.createDataFrame(rows + rows[:6], RECORD + ", key string")
    each = profile.cleaned(df.drop("key"), fold=False)
    side = lambda name, test: df.filter(test).select(F.col("entity_id").alias(name), "key")
    pairs = side("s1_entity_id", "source = 'S1'").join(side("candidate_entity_id", "source <> 'S1'"), "key")
    records = each.dropDuplicates(["entity_id"])
    by_pairs, by_keys = profile.linked(pairs, records, records), profile.linked_by(df, ["key"], fold=False)
    assert by_keys.count() < by_pairs.count() == by_keys.agg(F.sum("n")).first()[0]
    for measure in (profile.difficulty, profile.blocking_recall):
        a, b = (sorted(map(tuple, measure(x).collect())) for x in (by_pairs, by_keys))
        assert [pytest.approx(x) for x in a] == b
    dice = by_keys.filter("a_cname <> '' AND b_cname <> ''").select(profile.clean_dice("a_cname", "b_cname").alias("x"), text.bigram_dice(F.col("a_cname"), F.col("b_cname")).alias("y")).collect()
    assert len({r.x for r in dice}) > 3 and all(r.x == r.y for r in dice)


def test_difficulty_of_no_links(spark):
    none = profile.linked_by(spark.createDataFrame([], RECORD + ", key string"), ["key"])
    row = profile.difficulty(none).first()
    assert row["pairs"] == 0 == row["similar_names"] and row["name_dice"] is None


def boosting_rows(spark, n=1500):
    """Feature rows of few values, so that all of them are bins; labels follow two features with faults."""
    rows = []
    for i in range(n):
        x = [(i * (3 + j) // 7 + j * i) % (2 + j) / 4 for j in range(len(features.FEATURES))]
        rows.append((f"S1-{i % 97}", f"S2-{i}", "S2", *x, int((x[4] + x[9] > 1.5) != (i % 13 == 0))))
    return spark.createDataFrame(rows, features.TRAINING_ROW)


def scores(model, rows):
    return {r.candidate_entity_id: r.match_probability for r in learning.predict(model, rows.drop("label")).collect()}


def test_boosting_on_distinct_rows_is_spark_s(spark, monkeypatch):
    """The same trees as Spark fits on all rows, where neither draws any rows or features."""
    rows = boosting_rows(spark)
    held = F.crc32("s1_entity_id") % 4 == 0
    how = learning.Boosting(trees=12, rate=0.1, depth=4, rows=1.0, columns="all")
    found = []
    for most in (learning.MOST_DISTINCT, 0):
        monkeypatch.setattr(learning, "MOST_DISTINCT", most)
        model = learning.train(rows.filter(~held), rows.filter(held), how)
        found.append((model.stages[-1].getNumTrees, scores(model, rows), model.stages[-1].trees))
    (n, mine, trees), (m, spark_s, others) = found
    assert n == m > 3 and mine == {k: pytest.approx(v) for k, v in spark_s.items()} and len(set(mine.values())) > 20
    assert [t.numNodes for t in trees] == [t.numNodes for t in others]


def test_scores_don_t_depend_on_how_rows_are_dealt(spark, tmp_path):
    rows = boosting_rows(spark)
    how = learning.Boosting(trees=5, depth=3)
    one = scores(learning.train(rows.repartition(1), None, how, str(tmp_path / "model")), rows)
    assert one == scores(learning.train(rows.repartition(5, "candidate_entity_id"), None, how), rows) == scores(learning.load_model(spark, str(tmp_path / "model")), rows)
    assert one != scores(learning.train(rows, None, learning.Boosting(trees=5, depth=3, seed=1)), rows)


def test_cuts_are_between_few_values_and_at_equal_shares_of_many(spark):
    cuts = learning.split_points(spark.range(6400).select(*[(F.col("id") % 3 if j else F.col("id") / 6400).cast("double").alias(f) for j, f in enumerate(features.FEATURES)]))
    assert len(cuts[0]) == learning.BINS - 1 and cuts[0] == pytest.approx([k / 32 for k in range(1, 32)], abs=1e-3) and all(list(c) == [0.5, 1.5] for c in cuts[1:])
    none = learning.split_points(spark.createDataFrame([(0.0,) * 18, (-0.0,) * 18], ", ".join(f"{f} double" for f in features.FEATURES)))
    assert [len(c) for c in none] == [0] * 18


def test_address_paths_of_equal_records_are_those_of_each(spark):
    """Records that are alike, and ids that have several rows, against a loop over all pairs of rows."""
    rows = [(f"S{1 + i % 3}-{i // (2 if i % 5 == 0 else 1)}", ["Acme", "Acorn", "Bolt"][i % 3 if i % 2 else 0], ["12 Main St", "12 Oak Rd", "", "7 Main St"][i // 3 % 4], "US" if i % 6 else "FR", f"S{1 + i % 3}") for i in range(90)]
    ready = blocking.prepare(spark.createDataFrame(rows, RECORD)).localCheckpoint()
    how = blocking.Blocking(token_df=25, rarest=2, top=6)
    got = {(r.s1_entity_id, r.candidate_entity_id, r.candidate_source, r.score, r.place) for r in blocking.by_address(ready.filter("source = 'S1'"), ready.filter("source <> 'S1'"), how).collect()}
    all_rows = ready.collect()
    mine, pool = ([r for r in all_rows if (r.source == "S1") == s] for s in (True, False))
    mine = [r for r in mine if r.business_address or r.house]
    house = lambda r: (r.country, r.house.lower()) if r.house else None
    both = lambda r: (*house(r), r.key_name[:3]) if r.house else None
    small = lambda key: {k for k, n in Counter(map(key, pool)).items() if k and n <= how.token_df}
    df = Counter((r.country, t) for r in pool for t in r.address_tokens)
    tokens = {k: sorted((df[k[1], t], t) for r in mine if (r.entity_id, r.country) == k for t in r.address_tokens)[: how.rarest] for k in {(r.entity_id, r.country) for r in mine}}
    weight = Counter()
    for key, w, kept in ((both, 3, small(both)), (house, 1, small(house))):
        for a in mine:
            for b in pool:
                weight[a.entity_id, b.entity_id, b.source] += w * (key(a) in kept and key(a) == key(b))
    for (a, country), rarest in tokens.items():
        for n, t in rarest:
            for b in pool:
                weight[a, b.entity_id, b.source] += 2 * (n <= how.token_df and b.country == country and t in b.address_tokens)
    want = set()
    for a in {a for a, _, _ in weight}:
        best = sorted((-w, b, s) for (x, b, s), w in weight.items() if x == a and w)[: how.top]
        want |= {(a, b, s, -w, i + 1) for i, (w, b, s) in enumerate(best)}
    assert got == want and len(got) > 50


def test_labels_by_what_links_have_in_common(spark, tmp_path):
    parts = [(k, ["n", "m", None][k % 5 % 3] and f"n{k % 4}", "Brand#1" if k % 7 else None, "TIN", k % 9) for k in range(1, 80)] + [(6, "n3", "Brand#1", "TIN", 2)]
    spark.createDataFrame(parts, PART).write.parquet(f"{tmp_path}/part.parquet")
    p = catalog.Parts(spark, str(tmp_path))
    ids = lambda rows: sorted((r.s1_entity_id, r.candidate_entity_id, r.label) for r in rows.collect())
    both = ids(features.pair_features(p.pairs, *p.sides, links=p.link_keys)), ids(features.labelled(p.features, p.truth_lists))
    assert both[0] == both[1] and {x[2] for x in both[0]} == {0, 1}


def test_vocabulary_of_equal_texts_is_that_of_each(spark):
    rows = [(f"{i // 2 if i % 4 == 0 else i}", "US" if i % 3 else "FR", ["silver ring", "silver", "ring ring", ""][i % 4]) for i in range(40)]
    pool = spark.createDataFrame(rows, "entity_id string, country string, text string")
    each = tfidf.counts(pool).withColumn("n", F.lit(1))
    total = lambda d: {tuple(r) for r in d.groupBy("country", "term").agg(F.sum("n"), F.sum(F.col("tf") * F.col("n"))).collect()}
    assert total(tfidf.pool_counts(pool)) == total(each) and each.count() > 50
