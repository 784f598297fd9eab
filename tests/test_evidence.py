"""Evidence, narration, questions and the column graph."""

import json

import pytest

from assayer.errors import AssayError
from assayer.operators import evidence as V, graph as G, narrate as N, questions as K
from assayer.plans.table import TableProfile, together


@pytest.fixture(scope="module")
def people(spark):
    df = spark.createDataFrame([(
        i, 20 + i % 40, None if i % 4 == 0 else 1000.0 * (20 + i % 40), "abc"[i % 3],
        f"unit {i}") for i in range(40)],
        "id int, age int, income double, grade string, `unit price` string")
    return TableProfile(df, "people", ["id"])


@pytest.fixture(scope="module")
def words(spark):
    df = spark.createDataFrame([("x",), ("x",), ("y",)], "w string")
    return TableProfile(df, "words")


def test_summary_counts_and_caps(spark, people, words):
    both = [people, words]
    got = {r["dataset_id"]: r for r in V.evidence_summary(
        together(both, "dataset"), together(both, "facts"), together(both, "severities")
    ).collect()}
    assert got["people"]["row_count"] == 40 and len(got["people"]["columns"]) == 5
    assert got["words"]["warning_count"] == 1 and got["words"]["info_count"] == 1
    assert got["words"]["quality_finding_count"] == 2
    wide = TableProfile(spark.createDataFrame([tuple(range(45))], [f"c{i}" for i in range(45)]),
                        "wide")
    row = V.evidence_summary(wide.dataset, wide.facts, wide.severities).first()
    assert [c["column"] for c in row["columns"]] == [f"c{i}" for i in range(30)]
    assert V.evidence_quality(wide.findings).count() == 20
    assert wide.nodes.count() == 45


def test_narration_repeats_the_evidence_and_changes_nothing(people):
    evidence = V.evidence_summary(people.dataset, people.facts, people.severities)
    before = [r.asDict(recursive=True) for r in evidence.collect()]
    text = N.narrate_summary(evidence).first()["narration"]
    assert text.startswith("FACT: 40 rows and 5 columns.")
    assert [r.asDict(recursive=True) for r in evidence.collect()] == before
    told = {r["column"]: r["narration"] for r in N.narrate_column(people.columns).collect()}
    assert "25.0000% of its values are missing" in told["income"]
    assert "'a' is most frequent" in told["grade"]


def test_correlation_narration(people, words):
    text = N.narrate_correlation(
        V.evidence_correlation(people.pairs), people.correlation_status).first()["narration"]
    assert "'age' and 'income' have a coefficient of 1.000000 over 30 rows, a strong positive" in text
    none = N.narrate_correlation(
        V.evidence_correlation(words.pairs), words.correlation_status).first()["narration"]
    assert none == "FACT: Correlation needs two numeric columns; there are 0."


def test_model_evidence(spark):
    full = {"task_type": "regression", "target_column": "y", "model_name": "ridge_regression",
            "feature_columns": ["a", "b"], "train_size": 8, "test_size_actual": 2,
            "metrics": {"mae": 0.5}, "unavailable_metrics": {"r2": "too few rows"},
            "warnings": ["small"]}
    part = {k: v for k, v in full.items() if k not in ("metrics", "train_size")}
    df = spark.createDataFrame(
        [("a", json.dumps(full)), ("b", json.dumps(part)), ("c", "no json")],
        "result_id string, result string")
    got = {r["result_id"]: r for r in V.evidence_model(df).collect()}
    assert got["a"]["error"] is None and got["a"]["metrics"] == {"mae": 0.5}
    assert got["b"]["missing_fields"] == ["train_size", "metrics"]
    assert len(got["c"]["missing_fields"]) == 7 and got["c"]["model_name"] is None
    with pytest.raises(AssayError) as caught:
        V.require_model_result(V.evidence_model(df))
    assert caught.value.code == "ml_result_malformed"
    told = N.narrate_model(V.evidence_model(df)).collect()
    assert [r["result_id"] for r in told] == ["a"]
    assert "FACT: mae is 0.500000. FACT: r2 was not computed: too few rows. FACT: warnings: small" in \
        told[0]["narration"]


ASKED = {
    "Any duplicate rows?": ("deterministic_lookup", "0 rows are copies of another, 0.0000% of 40 rows."),
    "Which column has most missing data?": ("deterministic_lookup",
                                            "'income' misses most: 25.0000%, 10 of 40 rows."),
    "Is anything missing?": ("analytical_interpretation", None),
    "What is the strongest correlation?": ("deterministic_lookup",
                                           "'id' and 'age' correlate most: 1.000000 (Pearson)."),
    "What is the average AGE?": ("deterministic_lookup", "The mean of 'age' is 39.500000."),
    "the maximum of income, please": ("deterministic_lookup",
                                      "The max of 'income' is 59000.000000."),
    "median grade": ("analytical_interpretation", None),
    "average unit price": ("analytical_interpretation", None),
    "average of nothing": ("analytical_interpretation", None),
    "How did the model do on F1?": ("unsupported", None),
    "Any data quality problems?": ("explanation", None),
    "Tell me a story": ("analytical_interpretation", None),
}


def test_routing(spark, people):
    asked = spark.createDataFrame(
        [(q, "people", q) for q in ASKED], "question_id string, dataset_id string, question string")
    got = {r["question_id"]: (r["category"], r["answer"]) for r in K.route_questions(
        asked, people.dataset, people.numeric, people.pairs).collect()}
    assert got == ASKED
    models = spark.createDataFrame(
        [("people", "ridge", {"f1": 0.5, "accuracy": 0.75})],
        "dataset_id string, model_name string, metrics map<string,double>")
    answer = K.route_questions(
        asked.where("question_id LIKE '%F1%'"), people.dataset, people.numeric, people.pairs,
        models).first()["answer"]
    assert answer == "The model 'ridge' reported accuracy=0.750000, f1=0.500000."
    told = {r["question_id"]: r["narration"] for r in N.narrate_answer(K.route_questions(
        asked, people.dataset, people.numeric, people.pairs)).collect()}
    assert told["Tell me a story"] == N.NOT_ENOUGH and told["What is the average AGE?"] == \
        "FACT: The mean of 'age' is 39.500000."


def test_names_match_whole_words_only(spark):
    columns = spark.createDataFrame(
        [("d", 0, "age", "numeric", (1.0,) * 5), ("d", 1, "net price", "numeric", (2.0,) * 5),
         ("d", 2, "a.b", "numeric", (3.0,) * 5), ("d", 3, "größe", "numeric", (4.0,) * 5)],
        "dataset_id string, ordinal int, column string, semantic_type string, "
        "numeric_stats struct<min:double,max:double,mean:double,median:double,std:double>")
    asked = spark.createDataFrame([(q, "d", q) for q in (
        "average price", "mean net price", "mean aXb", "mean a.b", "mean größe", "mean größen")],
        "question_id string, dataset_id string, question string")
    got = {r["question_id"]: r["column"]
           for r in K.route_column_statistic(asked, columns).collect()}
    assert got == {"mean net price": "net price", "mean a.b": "a.b", "mean größe": "größe"}


def test_no_pairs_is_unsupported(spark, words):
    asked = spark.createDataFrame([("q", "words", "which columns correlate most?")],
                                  "question_id string, dataset_id string, question string")
    got = K.route_questions(asked, words.dataset, words.numeric, words.pairs).first()
    assert (got["category"], got["answer"]) == ("unsupported", None)


def test_graph(people):
    edges = people.edges.orderBy("rank").collect()
    assert (edges[0]["source"], edges[0]["target"]) == ("id", "age")
    order = [r["column"] for r in G.correlated_columns(people.edges).orderBy("first_touch").collect()]
    assert order == ["id", "age", "income"]
    nodes = {r["column"]: r for r in people.nodes.collect()}
    assert nodes["income"]["has_warning"] and not nodes["income"]["has_critical"]
    assert nodes["income"]["state"] == "idle" and nodes["age"]["null_percentage"] == 0.0
    ring = {r["column"]: r for r in G.analytics_nodes(
        people.edges, people.facts.where("column <> 'age'"), people.findings).collect()}
    assert ring["age"]["semantic_type"] == "unknown" and ring["age"]["null_percentage"] == 0.0


def test_search_and_filters(spark, people):
    def names(df):
        return sorted(r["column"] for r in df.collect())

    nodes = people.nodes
    assert names(G.column_search(nodes, " AG ")) == ["age"] and names(G.column_search(nodes, " ")) == []
    assert names(G.column_filter(nodes)) == names(nodes)
    assert names(G.column_filter(nodes, categorical=True)) == ["grade"]
    assert names(G.column_filter(nodes, categorical=True, missing=True)) == ["grade", "income"]
    model = spark.createDataFrame([("people", "unit price")], "dataset_id string, column string")
    assert names(G.column_filter(nodes, model_columns=model)) == ["unit price"]
    assert names(G.column_filter(
        nodes, correlated=G.correlated_columns(people.edges), query="I")) == ["id", "income"]
    assert names(G.column_filter(nodes, quality=True)) == ["income"]
