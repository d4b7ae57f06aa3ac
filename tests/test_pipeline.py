from pyspark.sql import functions as F

from shelfcast.operators import forecast as fc
from shelfcast.plans import fixtures as fx
from shelfcast.plans.pipeline import analyze, chat, run_document
from tests.conftest import SF001


def test_analyze_end_to_end(spark):
    a = analyze(fx.retail(spark, SF001), forest_factory=fc.forest(numTrees=10),
                boosting_factory=fc.boosting(rounds=5), run_id="r1")
    res = {r["model"]: r["status"] for r in a.results.collect()}
    assert set(res) == {"Random Forest", "Gradient Boosting", "Seasonal Baseline", "Window AR"}
    best = a.best.first()
    assert best["model"] in res and "Forecast reliability for this upload is" in best["reason"]
    assert a.forecast_summary.count() == 3
    assert a.forecast_summary.where(F.col("value") < 0).count() == 0
    assert a.recommendations.count() == 5
    meta = a.meta.first()
    assert meta["partial_last_period_removed"] and meta["partial_last_period"] == "2001-11"
    run = a.run.first()
    assert run["row_count"] == a.overview.first()["row_count"]
    qs = spark.createDataFrame([("r1", "Which items should I restock?"), ("r1", "What is the forecast?"),
                                ("r1", "How clean was the data?"), ("r1", "hello")], "run_id string, message string")
    ans = {r["message"]: r["answer"] for r in chat(a.run, qs).collect()}
    assert ans["What is the forecast?"].startswith("The current 3-month forecast based on " + best["model"])
    assert ans["How clean was the data?"].startswith("The upload pipeline")
    assert ans["hello"].startswith("This run used")
    doc = run_document(a, "retail.csv", 123)
    assert doc.count() == 1 and "monthly_series" in doc.columns
    row, frame = doc.first(), a.cleaning.frame
    assert len(row["preview_rows"]) == 12 and list(row["preview_rows"][0].asDict()) == frame.columns
    assert row["overview"]["columns"] == frame.columns and row["overview"]["row_count"] == frame.count()
    assert row["overview"]["target_sum"] == a.overview.first()["target_sum"]
    assert [(c["type"], tuple(c["columns"])) for c in row["context_columns"]] == [(t, tuple(c)) for t, c in a.schema.context_columns]
    assert row["cleaning_summary"]["duplicates_removed"] == a.cleaning.summary.first()["duplicates_removed"]
    assert [r["item"] for r in row["recommendations"]] == [r["item"] for r in a.recommendations.collect()]
    assert row["file"]["name"] == "retail.csv" and row["best_model"]["model"] == best["model"]


def test_analyze_with_series_keys(spark):
    a = analyze(fx.retail(spark, SF001), series_keys=["item_type"], forest_factory=fc.forest(numTrees=5),
                boosting_factory=fc.boosting(rounds=3), run_id="r2")
    n_types = fx.retail(spark, SF001).select("item_type").distinct().count()
    assert a.results.count() == 4 * n_types
    assert a.best.count() == n_types and a.confidence.count() == n_types
    assert a.forecast_summary.groupBy("item_type").count().where("count = 3").count() == n_types
    assert a.meta.count() == n_types
    run = a.run
    assert run.count() == n_types and run.where("best_model IS NULL OR forecast_points IS NULL").count() == 0
    qs = run.select("run_id", "item_type", F.lit("What is the forecast?").alias("message"))
    ans = chat(run, qs, on=["run_id", "item_type"]).collect()
    assert len(ans) == n_types and all(r["answer"].startswith("The current 3-month forecast") for r in ans)
    docs = run_document(a, "retail.csv", 123, ["item_type"])
    docs = docs.collect()
    assert len(docs) == n_types and len({r["item_type"] for r in docs}) == n_types
    assert all(len(r["model_results"]) == 4 and len(r["forecast_summary"]) == 3 and r["best_model"]["model"] for r in docs)
    assert all(r["preview_rows"] == docs[0]["preview_rows"] and len(r["preview_rows"]) == 12 for r in docs)
    months = {r["item_type"]: r["n"] for r in a.monthly.groupBy("item_type").agg(F.count("*").alias("n")).collect()}
    assert all(len(r["monthly_series"]) == months[r["item_type"]] for r in docs)
