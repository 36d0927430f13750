"""Held-out accuracy of the fitted operators on the given tables; `python -m tests.llm.accuracy DIR...`."""

import os
import sys

if __name__ == "__main__":
    os.environ["PYTHONPATH"] = os.getcwd()
    from pyspark.sql import SparkSession

    from corvid.llm.queries import op4_language_id, op10_toxicity

    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    for folder in sys.argv[1:]:
        langs = session.read.parquet(f"{folder}/documents.parquet").where("lang is not null").select("doc_id", "lang")
        right = op4_language_id(session, folder).where("held_out").join(langs, "doc_id").selectExpr("avg(cast(lang = lang_pred as double)) as share", "count(*) as n").first()
        labels = session.read.parquet(f"{folder}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
        held = op10_toxicity(session, folder).where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").toPandas()
        bad, place = held["toxic"] == 1, held["score"].rank()
        area = (place[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum())
        print(f"{folder}: language right {right.share:.4f} of {right.n}; toxicity AUC {area:.4f}, right {(held['predicted'] == bad).mean():.4f} of {len(held)}", flush=True)
