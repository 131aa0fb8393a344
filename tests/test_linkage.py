"""Linkage rules on small hand-made tables; expected values are worked out by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kinloom.functions import text as X
from kinloom.functions import unicode as U
from kinloom.functions.hashing import unit_interval
from kinloom.operators import metrics, retrieve, sample, splits, truth, validate, variation
from kinloom.sources import sinks, tsv


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("t", "p", "score"), [(["a"], ["a"], 1.0), (["a"], [], 0.0), ([], ["a"], 0.0), ([], [], 1.0), (["a", "b"], ["a"], 5 / 6), (["a", "b"], ["a", "b", "c"], 5 / 7)]
)
def test_f_beta(spark, t, p, score):
    got = spark.createDataFrame([(t, p)], "t array<string>, p array<string>").select(metrics.f_beta(F.col("t"), F.col("p"))).first()[0]
    assert got == pytest.approx(score)


def frame(spark, rows):
    return spark.createDataFrame(rows, "qid string, ids array<string>")


def test_scores_and_checks(spark):
    t = frame(spark, [("q1", ["a", "b"]), ("q2", []), ("q3", ["c"])])
    p = frame(spark, [("q1", ["a"]), ("q2", []), ("q3", ["x"]), ("other", ["y"])])
    assert metrics.macro_mean(metrics.score_queries(t, p)).first()[0] == pytest.approx((5 / 6 + 1 + 0) / 3)
    with pytest.raises(ValueError, match="without a prediction"):
        metrics.score_queries(t, frame(spark, [("q1", ["a"])]))
    with pytest.raises(ValueError, match="without truth"):
        metrics.score_queries(t, p, frame(spark, [("zz", [])]))
    with pytest.raises(ValueError, match="repeated"):
        metrics.score_queries(t, p, t.unionByName(t))
    r = metrics.candidate_recall(t, frame(spark, [("q1", ["a"]), ("q3", ["c"])])).first()
    assert (r["micro_recall"], r["macro_recall"], r["n_queries"]) == (pytest.approx(2 / 3), 0.75, 2)
    assert metrics.macro_mean(metrics.oracle_scores(frame(spark, [("q", ["a", "b"])]), frame(spark, [("q", ["a", "x"])]))).first()[0] == pytest.approx(5 / 6)
    none = metrics.candidate_recall(frame(spark, [("q", [])]), frame(spark, [])).first()
    assert math.isnan(none["micro_recall"]) and none["n_queries"] == 0
    assert metrics.macro_mean(metrics.score_queries(frame(spark, []), frame(spark, []))).first()[0] == 0.0


def test_truth(spark):
    rows = [("S1-1", "S2-1, S3-1", 0), ("S1-2", "", 1), ("S1-1", "S2-9", 2), ("S1-3", "S2-2,S2-2,S1-9,X,S3-4", 3)]
    t = spark.createDataFrame(rows, "source1_entity_id string, matched_entity_ids string, row_id long")
    got = {(r["s1_id"], r["place"]): r["status"] for r in truth.parse_entries(t).collect()}
    assert got == {("S1-1", 0): "ok", ("S1-1", 1): "ok", ("S1-3", 0): "ok", ("S1-3", 1): "duplicate", ("S1-3", 2): "self_match", ("S1-3", 3): "bad_prefix", ("S1-3", 4): "ok"}
    assert {r["qid"]: r["ids"] for r in truth.truth_sets(t).collect()} == {"S1-1": ["S2-1", "S3-1"], "S1-2": [], "S1-3": ["S2-2", "S3-4"]}
    assert [r["s1_id"] for r in truth.repeated_rows(t).collect()] == ["S1-1"]


def test_families(spark):
    edges = spark.createDataFrame([("S1-9", "a"), ("S1-2", "a"), ("S1-2", "b"), ("S1-5", "b"), ("S1-5", "c"), ("S1-7", "c"), ("S1-3", "z")], "s1_id string, target_id string")
    nodes = spark.createDataFrame([(f"S1-{k}",) for k in (2, 3, 4, 5, 7, 9)], "s1_id string")
    got = {r["node"]: r["family_id"] for r in truth.families(nodes, edges).collect()}
    assert got == {"S1-2": "S1-2", "S1-5": "S1-2", "S1-7": "S1-2", "S1-9": "S1-2", "S1-3": "S1-3", "S1-4": "S1-4"}
    assert [tuple(r) for r in truth.multi_owner_targets(edges).orderBy("target_id").collect()] == [("a", 2), ("b", 2), ("c", 2)]


def test_splits(spark):
    assert spark.range(1).select(unit_interval(42, F.lit("S1-1"))).first()[0] == pytest.approx(0.9038884561591242, abs=1e-15)
    rows = spark.createDataFrame([(f"S1-us-{i}", "US") for i in range(800)] + [(f"S1-in-{i}", "India") for i in range(200)], "k string, c string")
    a = splits.assign_splits(rows, "k", ("c",))
    counts = {(r["c"], r["split"]): r["count"] for r in a.groupBy("c", "split").count().collect()}
    assert counts == {("US", "train"): 640, ("US", "tuning"): 80, ("US", "holdout"): 80, ("India", "train"): 160, ("India", "tuning"): 20, ("India", "holdout"): 20}
    again = splits.assign_splits(rows.orderBy(F.desc("k")), "k", ("c",))
    assert splits.fingerprint(a, "k").first() == splits.fingerprint(again, "k").first()
    other = splits.assign_splits(rows, "k", ("c",), splits.SplitConfig(seed=7))
    assert splits.fingerprint(a, "k").first() != splits.fingerprint(other, "k").first()
    with pytest.raises(ValueError, match="sum"):
        splits.SplitConfig(train_frac=0.9)
    assert {r["split"]: r["n"] for r in splits.split_counts(a.limit(0)).collect()} == {"train": 0, "tuning": 0, "holdout": 0}


@pytest.mark.parametrize(
    ("value", "column", "want"),
    [
        ("Acme Private Ltd", X.legal_form_reduced, "acme"), ("Acme Ltd Consulting", X.legal_form_reduced, "acme ltd consulting"), ("Coco Bakery", X.legal_form_reduced, "coco bakery"),
        ("Ltd", X.legal_form_reduced, ""), ("Smith & Sons, LLC.", X.tokenize, ["smith", "sons", "llc"]), ("1795 Oak St, Suite 012", X.numeric_tokens, ["1795", "012"]),
        ("Café Müller", U.fold_latin, "Cafe Muller"), (" US\t", X.normalize_country, "us"), (None, X.normalize_country, ""), (None, X.tokenize, []), ("Straße", X.tokenize, ["strasse"]),
        ("\u00a0\t\x1c", X.is_missing, True), ("NA", X.is_missing, False), (" N/A ", X.is_null_field, True), ("मार्केटिंग", X.audit_tokens, ["मार्केटिंग"]),
        ("मार्केटिंग", X.tokenize, ["म", "र", "क", "ट", "ग"]), ("Acme Tools Ltd", X.initials, "atl"), ("abc дом", U.scripts, ["CYRILLIC", "LATIN"]), ("x dba: Foo Bar", X.alias_of, "Foo Bar"),
        ("https://www.acme-tools.com/x", X.domain_stem, "acme-tools"),
    ],
)
def test_text(spark, value, column, want):
    assert one(spark, value, column) == want


def labels(spark, a, b):
    rows = spark.createDataFrame([(1, *a, *b)], "i int, n1 string, a1 string, c1 string, n2 string, a2 string, c2 string")
    side = lambda k, s: variation.prepared(rows.select("i", F.col(f"n{k}").alias("business_name"), F.col(f"a{k}").alias("business_address"), F.col(f"c{k}").alias("country")), s, ("i",))
    return variation.label_pairs(side(1, "a").join(side(2, "b"), "i")).first()


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        (("Acme", "1 Oak St", "US"), ("Acme", "1 Oak St", "US"), {"unchanged_record"}),
        (("Acme", "1 Oak St", "US"), ("ACME", "1 Oak Street", "US"), {"name_case_only", "address_abbreviation_or_state_expansion", "address_possible_typo"} - {"address_possible_typo"}),
        (("Café One", "x", "FR"), ("Cafe One", "x", "FR"), {"name_accent_change"}),
        (("Blue Sky", "x", "US"), ("Sky Blue", "x", "US"), {"name_word_reordering"}),
        (("Blue Sky Ltd", "x", "US"), ("Blue Sky", "x", "US"), {"name_legal_suffix_change", "name_token_addition_or_removal"}),
        (("International Business Machines", "x", "US"), ("IBM", "x", "US"), {"name_initialism_candidate", "name_low_lexical_overlap"}),
        (("", "x", "US"), ("A", "x", "us"), {"name_missing"}),
        (("A", "9 Oak, Fridley, MN", "US"), ("A", "9 Oak, Fridley, TX", "US"), {"us_state_conflict_candidate", "address_possible_typo"}),
        (("A", "007 Elm", "DE"), ("A", "7 Elm", "FR"), {"address_numeric_tokens_changed", "address_leading_zero_number_format", "country_mismatch", "address_possible_typo"} - {"address_possible_typo"}),
    ],
)
def test_labels(spark, a, b, want):
    got = set(labels(spark, a, b)["labels"])
    assert want <= got and got - want <= {"address_possible_typo"}


def test_location(spark):
    r = labels(spark, ("Star Duke Inc", "5531 E Bavarian Pass, Fridley, MN", "US"), ("Mirasol", "5531 EAST BAVARIAN PASS, FRIDLEY, MN", "US"))
    assert set(r["labels"]) == {"address_abbreviation_or_state_expansion", "name_legal_suffix_change", "name_low_lexical_overlap"}
    assert (r["address_token_jaccard"], r["s1_us_state"], r["matched_us_city"]) == (1.0, "MN", "fridley")


def test_tsv_round_trip(spark, tmp_path):
    f = tmp_path / "s1.tsv"
    f.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\textra\nS1-1\tA\t\tUS\t1\nS1-2\tNA\t"q, t"\tIndia\t2\nS1-3\tnan "x"\tz\tFrance\t3\n', encoding="utf-8")
    out = str(tmp_path / "t.parquet")
    assert sinks.ingest_to_parquet(spark, str(f), "S1", out)["row_count"] == 3
    rows = tsv.read_table(spark, out).orderBy("row_id").collect()
    assert [(r["row_id"], r["source"], r["entity_id"], r["business_address"]) for r in rows] == [(0, "S1", "S1-1", ""), (1, "S1", "S1-2", "q, t"), (2, "S1", "S1-3", "z")]
    assert rows[1]["business_name"] == "NA" and not list(tmp_path.glob("*.tmp"))
    assert {r["entity_id"]: r["row_id"] for r in tsv.entity_index(tsv.read_table(spark, out)).collect()} == {"S1-1": 0, "S1-2": 1, "S1-3": 2}
    assert {r["id"] for r in tsv.read_ids(spark, str(f)).collect()} == {"S1-1", "S1-2", "S1-3"}
    with pytest.raises(ValueError, match="matched_entity_ids"):
        tsv.read_truth(spark, str(f))


def test_validation(spark, tmp_path):
    required = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "id string")
    valid = spark.createDataFrame([("S2-1",), ("S2-2",), ("S3-1",)], "id string")
    m, c = tmp_path / "m.tsv", tmp_path / "c.tsv"
    c.write_text("source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-1,S3-1\nS1-2\tS2-2\nS1-3\t\n")
    m.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\nS1-2\t\nS1-3\t\n")
    found, n = validate.validate_outputs(spark, str(m), str(c), required, valid)
    assert validate.is_ok(found) and n == 6
    m.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S2-1,S1-1,X, S2-1,S2-9\nS1-1\tS2-2\nno tab\n\nS1-7\tS3-1\n")
    found, _ = validate.validate_outputs(spark, str(m), str(c), required, valid)
    rules = {r["rule"]: r["n"] for r in validate.examples(found).collect()}
    assert rules == {"duplicate_row": 1, "duplicate_id_in_list": 1, "self_match": 1, "wrong_prefix": 2, "unknown_id": 1, "missing_required": 2, "extra_row": 1, "malformed_row": 1, "retrieval_lineage": 2}
    soft, _ = validate.validate_outputs(spark, str(m), None, required, None, strict=False)
    assert {r["severity"] for r in soft.where("rule = 'not_given'").collect()} == {"warning"}
    gone, _ = validate.validate_outputs(spark, str(tmp_path / "none"), str(c), required, valid)
    assert gone.where("rule = 'not_found'").count() == 1


def test_sampling(spark):
    rows = spark.createDataFrame([(f"e{k}",) for k in range(30)], "entity_id string")
    a = sample.sample_rows(rows, "entity_id", 10).collect()
    assert a == sample.sample_rows(rows.repartition(3), "entity_id", 10).collect() and len(a) == 10
    with pytest.raises(ValueError, match="30"):
        sample.sample_rows(rows, "entity_id", 31)
    with pytest.raises(ValueError, match="not found"):
        sample.select_rows(rows, "entity_id", spark.createDataFrame([("zz",)], "id string"))
    labelled = spark.createDataFrame([("a", ["x"]), ("b", ["x", "y"]), ("c", ["x"]), ("d", ["z"])], "entity_id string, labels array<string>")
    assert set(sample.greedy_coverage(labelled, 3)) >= {"b", "d"}


def test_retrieval(spark):
    q = spark.createDataFrame([("q", ["rare", "common"])], "qid string, w array<string>")
    t = spark.createDataFrame([("t1", ["rare"]), ("t2", ["common"]), ("t3", ["common"]), ("t4", ["common", "rare"])], "id string, w array<string>")
    index = retrieve.postings(t, "id", "w")
    r = retrieve.route(retrieve.postings(q, "qid", "w"), index, 4, "name", 10, 2)
    assert {x["id"] for x in r.collect()} == {"t1", "t4"}
    f = retrieve.fuse([r, retrieve.route(retrieve.postings(q, "qid", "w"), index, 4, "all", 10, 9)])
    top = retrieve.budget(f, 2).orderBy("final_candidate_rank").collect()
    assert [x["id"] for x in top] == ["t1", "t4"] and top[0]["rrf"] == pytest.approx(1 / 61 + 1 / 62)
    out = retrieve.with_manifest(spark.createDataFrame([("q",), ("p",)], "qid string"), retrieve.budget(f, 2))
    assert out.where("id IS NULL").count() == 1


def test_hard_negatives_count_common_words(spark, tmp_path):
    from kinloom.plans import catalog

    texts = {k: " ".join(["everybody", "somebodyelse" if k % 2 else "othermatter", *(["occasionally"] if k % 3 == 0 else [])]) for k in range(600)}
    asked = {1: "everybody occasionally somebodyelse", 2: "othermatter", 3: "everybody"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(asked.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = {w: sum(w in t.split() for t in texts.values()) for w in " ".join(texts.values()).split()}
    got = {}
    for r in catalog.hard_negatives(spark, str(tmp_path)).collect():
        got.setdefault(r["qid"], []).append((r["final_candidate_rank"], r["id"]))
    for q, words in asked.items():
        score = {k: sum(math.log(601 / (df[w] + 1)) for w in set(words.split()) & set(t.split())) for k, t in texts.items() if set(words.split()) & set(t.split())}
        best = sorted(score, key=lambda k: (-round(score[k], 9), k))[:6]
        assert [x[1] for x in sorted(got[q])] == best[1:]


def test_families_of_long_chains(spark):
    """Many rounds leave no guessed size behind whose digits grow with each."""
    from kinloom.operators import truth

    names = [f"S1-{k:04d}" for k in range(600)]
    order = random.Random(4).sample(names, 600)
    edges = [(s, f"t{k + d}") for k, s in enumerate(order[:590]) for d in (0, 1)]
    family = truth.families(spark.createDataFrame([(s,) for s in names], "s1_id string"), spark.createDataFrame(edges, "s1_id string, target_id string"))
    want = {s: s if s in order[590:] else min(order[:590]) for s in names}
    assert {r["node"]: r["family_id"] for r in family.collect()} == want
    size = family._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert int(str(size)).bit_length() < 200
