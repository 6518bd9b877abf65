"""The stage runner: named stages over a dataset folder, each writing one table."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.catalog.base import Tables, queries
from siftspark.functions.model import Model, RuleModel, embedded, extract_events
from siftspark.functions.text import whole_text
from siftspark.operators.signal import signal_filter

_POST = ("title", "body", "subreddit", "score", "num_comments", "upvote_ratio", "trust_level", "category")


def _extract(t: Tables, model: Model) -> DataFrame:
    posts = t.posts(*_POST)
    passed = signal_filter(posts).filter("pass_type IS NOT NULL").select("id")
    return extract_events(posts.join(passed, "id", "left_semi").select("id", whole_text().alias("text")), model)


def _embed(t: Tables, model: Model) -> DataFrame:
    rows = t.events("problem", "context").select("id", F.concat_ws(" | ", "problem", "context").alias("text"))
    return embedded(rows)


STAGES: dict[str, Callable[[Tables, Model], DataFrame]] = {
    "fetch": lambda t, m: t.posts("title", "body", "subreddit", "author", "score", "num_comments"),
    "filter": lambda t, m: signal_filter(t.posts(*_POST)),
    "extract": _extract,
    "embed": _embed,
    "cluster": lambda t, m: queries()["g07_cluster_metrics"](t.spark, t.folder),
    "changes": lambda t, m: queries()["st11_change_detection"](t.spark, t.folder),
    "lifecycle": lambda t, m: queries()["st08_orphan_expiry"](t.spark, t.folder),
    "shortlist": lambda t, m: queries()["w05_top_candidates"](t.spark, t.folder),
}


def run_single_stage(spark: SparkSession, folder: str, stage: str, out: str, model: Model | None = None) -> dict:
    """Run one stage and write its table to ``out/stage``; returns {stage, started, ended, items}. An unknown stage raises."""
    if stage not in STAGES:
        raise ValueError(f"no stage {stage}; there are {', '.join(STAGES)}")
    started = time.time()
    STAGES[stage](Tables(spark, folder), model or RuleModel()).write.mode("overwrite").parquet(f"{out}/{stage}")
    return {"stage": stage, "started": started, "ended": time.time(), "items": spark.read.parquet(f"{out}/{stage}").count()}


def run_full_pipeline(spark: SparkSession, folder: str, out: str, stop_on_error: bool = True, model: Model | None = None) -> list[dict]:
    """Run all stages in order; a failing one is reported with its error and, with ``stop_on_error``, ends the run."""
    results = []
    for stage in STAGES:
        try:
            results.append(run_single_stage(spark, folder, stage, out, model))
        except Exception as error:
            results.append({"stage": stage, "error": str(error)[:300]})
            if stop_on_error:
                break
    return results
