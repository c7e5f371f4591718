"""Detection from SQL text, failures of own backends, turns without a confidence, unions without a setting."""

import pytest
from pyspark.sql import functions as F

from lexispark.operators import backends as B
from lexispark.operators import context
from lexispark.plans import sql
from lexispark.plans.config import Config
from lexispark.plans.detect import RESULT, detect
from lexispark.streaming.context import summary

TEXTS = [(1, "der hund und die katze sind nicht auf dem tisch", 7), (2, "the house and the garden", 8), (None, "que la vida es sueño", 9), (3, None, 1), (4, "", 2), (5, "12345 !!", 3), (2, "the house and the garden", 8), (6, "le chat et la souris " * 20_000, 4)]


@pytest.mark.parametrize("name", ["ngram_nb", "ngram_rank"])
def test_table_functions_equal_the_backends(spark, name):
    texts = spark.createDataFrame(TEXTS, "id long, text string, backend_name int").repartition(3)
    texts.createOrReplaceTempView("sql_odd")
    assert sql.register(spark) == ["ngram_nb", "ngram_rank"]
    key = lambda r: (str(r["id"]), r["backend_name"], r["language"], round(r["confidence"], 9), r["is_reliable"], sorted(r["all_probabilities"].items()))
    got = spark.sql(f"SELECT * FROM {name}(TABLE(sql_odd))")
    want = B.create_backend(name)(texts)
    assert got.columns == want.columns and sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString().split("BatchEvalPythonUDTF")[0].split("ArrowEvalPythonUDTF")[0]
    assert spark.sql(f"SELECT * FROM {name}(TABLE(SELECT * FROM sql_odd WHERE false))").count() == 0


def test_table_function_with_a_model_of_ones_own(spark, monkeypatch):
    model = B.train_ngrams(spark.createDataFrame([("xx", "qaq qeq qiq"), ("yy", "zaz zez ziz")], "lang string, text string"))
    sql.register(spark, {"own_nb": model})
    got = spark.sql("SELECT id, language FROM own_nb(TABLE(SELECT * FROM VALUES (1L, 'qaq'), (2L, 'ziz'), (3L, '--') AS t(id, text)))").collect()
    assert sorted(map(tuple, got)) == [(1, "xx"), (2, "yy"), (3, "unknown")]
    monkeypatch.setattr(B, "MODEL_ROWS", 3)
    with pytest.raises(ValueError):
        sql.register(spark, {"own_nb": model})


def test_view_of_the_whole_plan(spark):
    texts = spark.createDataFrame([(i, *row[1:]) for i, row in enumerate(TEXTS)], "doc_id long, body string, lang int")
    texts.createOrReplaceTempView("sql_bodies")
    config = Config(mode="short")
    sql.detected(spark, "sql_bodies", id="doc_id", text="body", config=config, top_k=2)
    got = spark.sql("SELECT * FROM sql_bodies_detected")
    want = detect(texts.select(F.col("doc_id").alias("id"), F.col("body").alias("text")), config, top_k=2)
    assert got.columns == RESULT and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_failures_of_own_backends_are_counted(spark):
    class Picky(B.Backend):
        name = "picky"

        def detect(self, text):
            if "x" in text:
                raise ValueError(text)
            return ("en", 0.5, None, True)

    assert B.failed_texts("picky") == 0
    rows = spark.createDataFrame([(1, "a"), (2, "x"), (3, "xx"), (4, None)], "id long, text string").repartition(2)
    assert sorted(r["id"] for r in B.row_wise(Picky, "picky")(rows).collect()) == [1, 4]
    assert B.failed_texts("picky") == 2
    B.row_wise(Picky, "picky")(rows.filter("id = 2")).collect()
    assert B.failed_texts("picky") == 3


@pytest.mark.parametrize("missing", [None, float("nan")])
def test_a_turn_without_a_confidence_has_age_but_no_weight(spark, missing):
    turns = [("a", 0, "en", 0.8), ("a", 1, "fr", missing), ("a", 2, "fr", 0.5), ("b", 0, "fr", missing)]
    rows = context.with_window(spark.createDataFrame([(c, t, x, v) for c, t, x, v in turns], "conv_id string, turn long, lang string, confidence double"), 5)
    out = rows.select("conv_id", "turn", context.distribution(F.col("window")).alias("d"), context.boost(F.col("window"), F.lit("en")).alias("boost")).collect()
    got = {(r["conv_id"], r["turn"]): ({x["lang"]: x["share"] for x in r["d"]}, r["boost"]) for r in out}
    history = [(x, float("nan") if v is None else v) for c, _, x, v in turns if c == "a"]
    for n in (1, 2, 3):
        top, share, _, _ = summary(history[:n])
        assert got["a", n - 1][0][top] == pytest.approx(share)
    assert got["a", 1][0] == {"en": 1.0} and got["a", 1][1] == pytest.approx(0.15)
    assert got["b", 0] == ({}, 0.0) and summary([("fr", float("nan"))]) == (None, 0.0, 1, 0.0)


def test_unions_of_branches_with_different_partitionings(spark):
    """As Spark sets it, and in a session in which nothing else ran, a union keeps all rows of its branches."""
    own = spark.newSession()
    base = own.range(0, 3000, 1, 3).select("id", (F.col("id") % 3).alias("c"))
    rest = base.filter("c = 2")
    counted = rest.select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("e")).groupBy("id").agg(F.sum("e").alias("n"))
    branches = [base.filter("c = 0").select("id", F.lit(0).alias("n")), base.filter("c = 1").select("id", F.lit(1).alias("n")).repartition(7, "id"), rest.join(counted, "id").select("id", "n")]
    labels = own.range(3000).withColumn("y", F.col("id") * 2).repartition(6, "id")
    for limit in ("-1", "10MB"):
        own.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        both = branches[0].unionByName(branches[1]).unionByName(branches[2]).join(labels, "id")
        assert sorted(map(tuple, both.groupBy("n").agg(F.count("*"), F.sum("y")).collect())) == [(0, 1000, 2997000), (1, 1000, 2999000), (3, 1000, 3001000)]
