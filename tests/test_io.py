import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from siftspark.functions import model
from siftspark.operators import sinks
from siftspark.plans import stages
from siftspark.sources import landing
from siftspark.streaming import events as S

SMALL = "/root/testdata/sf0.001"


def lines(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows) + "\nnot json\n")
    return str(path)


def test_forum_posts(spark, tmp_path):
    path = lines(tmp_path / "a.json", [{"id": "x1", "title": "T", "selftext": "B", "author": None, "created_utc": 1704067200, "extra": 1}, {"title": "no id"}])
    got = landing.forum_posts(spark, path).collect()
    assert [(r["id"], r["author"], r["score"], r["created_at"]) for r in got] == [("reddit_x1", "[deleted]", 0, dt.datetime(2024, 1, 1))]


def test_stories_and_comments(spark, tmp_path):
    rows = [{"id": 1, "title": "Ask HN: why", "kids": list(range(20, 35))}, {"id": 2, "title": "Plain", "descendants": 11}, {"id": 3, "title": "Plain", "descendants": 10}, {"id": 4, "title": "Show HN: x"}]
    got = landing.stories(spark, lines(tmp_path / "s.json", rows))
    assert sorted((r["source_id"], r["kind"]) for r in got.collect()) == [("1", "ASK"), ("2", "STORY"), ("4", "SHOW")]
    bodies = spark.createDataFrame([(20, "hello")], "id long, body string")
    comments = landing.comments_of(got, bodies).orderBy("place").collect()
    assert len(comments) == 10 and comments[0]["body"] == "hello"


def test_fan_out_config_reports_metrics(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("core:\n  trust_level: 0.9\n  SaaS: {min_upvotes: 5}\nignore:\n  x: {a: 1}\n")
    got = landing.fan_out(spark, landing.read_config(str(tmp_path / "c.yaml"))).collect()
    assert [(r["group"], r["subreddit"]) for r in got] == [("core", "SaaS")]
    (tmp_path / "r.md").write_text("# a\nb")
    assert landing.reports(spark, str(tmp_path / "r.md")).head()["content"] == "# a\nb"
    (tmp_path / "m.json").write_text(json.dumps([{"stage": "filter", "started": 1.0, "ended": 3.0, "items": 4}]))
    assert landing.metrics(spark, str(tmp_path / "m.json")).select((F.col("ended") - F.col("started")).alias("s")).head()["s"] == 2.0


def test_next_ids_are_consecutive_in_order(spark):
    df = spark.range(100).select(((F.col("id") * 37) % 101).alias("k"), F.lit("x").alias("__v"))
    got = sinks.with_next_ids(df, ["k"], after=10).orderBy("k").collect()
    assert [r["id"] for r in got] == list(range(11, 111))
    assert sinks.with_next_ids(df.limit(0), ["k"]).count() == 0


def test_upsert_folder_keeps_the_newest_and_is_idempotent(spark, tmp_path):
    make = lambda rows: spark.createDataFrame([(k, dt.datetime(2024, 1, d), v) for k, d, v in rows], "id string, at timestamp, v int")
    first = make([("a", 1, 1), ("b", 5, 2)])
    sinks.upsert_folder(spark, str(tmp_path), first, "id", "at")
    second = make([("a", 2, 3), ("b", 4, 4), ("c", 1, 5)])
    for _ in range(2):
        sinks.upsert_folder(spark, str(tmp_path), second, "id", "at")
    assert sorted((r["id"], r["v"]) for r in sinks.read_folder(spark, str(tmp_path)).collect()) == [("a", 3), ("b", 2), ("c", 5)]


def test_upsert_folder_rewrites_touched_parts_only(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "id string, at int, v int")
    sinks.upsert_folder(spark, str(tmp_path), make([(f"k{i}", 1, i) for i in range(200)] + [(None, 1, 1)]), "id", "at")
    before = sinks.newest_version(spark, str(tmp_path))
    sinks.upsert_folder(spark, str(tmp_path), make([("k3", 2, -1)]), "id", "at")
    after = sinks.newest_version(spark, str(tmp_path))
    assert len(set(after) - set(before)) == 1 and len(before) == len(after)
    got = {r["id"]: r["v"] for r in sinks.read_folder(spark, str(tmp_path)).collect()}
    assert got == {f"k{i}": -1 if i == 3 else i for i in range(200)}
    sinks.upsert_folder(spark, str(tmp_path), make([]), "id", "at")
    assert sinks.newest_version(spark, str(tmp_path)) == after


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "One", None), (2, "Two", 3.0)], "id int, name string, score double")
    assert "## One\n- score: -" in sinks.markdown_report(df, "Top", "name", ["score"])
    assert sinks.json_report(df, str(tmp_path / "j")) and not sinks.json_report(df.limit(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_model_answers_are_repaired_and_retried():
    assert model.repaired('say **{"a": "x\ny"}** done') == {"a": "x y"}
    assert model.repaired("nothing") == {"error": "no JSON", "raw": "nothing"}
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert model.with_retries(flaky, sleep=waits.append) == "ok" and waits == [1.0, 2.0]


def test_extraction_and_embedding(spark):
    df = spark.createDataFrame([("1", "I hate this. Fine."), ("2", None), ("3", "  "), ("4", "all good")], "id string, text string")
    got = model.extract_events(df, model.RuleModel()).collect()
    assert [(r["post_id"], r["problem"]) for r in got] == [("1", "I hate this.")]
    vectors = model.embedded(df).collect()
    assert sorted(r["id"] for r in vectors) == ["1", "4"] and all(len(r["embedding_vector"]) == 64 for r in vectors)


def test_long_sentences_are_whole_and_the_validator_sees_their_length(spark):
    from siftspark.catalog import more

    long = "word " * 300 + "and I hate this"
    df = spark.createDataFrame([("1", "", long, "s"), ("2", "", "I hate this thing.", "s")], "id string, title string, body string, subreddit string")

    class Posts:
        def posts(self, *columns):
            return df.select("id", *columns)

    assert {r["post_id"]: r["problem"] for r in more.u01(Posts()).collect()}["1"].endswith(long)
    assert [r["post_id"] for r in more.u02(Posts()).collect()] == ["2"]


def test_stage_runner(spark, tmp_path):
    done = stages.run_full_pipeline(spark, SMALL, str(tmp_path))
    assert [d["stage"] for d in done] == list(stages.STAGES) and all(d["items"] > 0 for d in done)
    with pytest.raises(ValueError):
        stages.run_single_stage(spark, SMALL, "none", str(tmp_path))


def _memory(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name)


@pytest.fixture
def landed(spark, tmp_path):
    rows = [(f"k{i % 7}", dt.datetime(2024, 1, 1 + i // 10, i % 10), i) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, at timestamp, v int")
    for part in range(3):
        df.filter(F.col("v") % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return df, str(tmp_path / "in"), str(tmp_path)


def test_streamed_upserts_equal_the_batch(spark, landed):
    df, folder, root = landed
    S.upsert_stream(S.file_stream(spark, folder, df.schema), f"{root}/out", "id", "at", f"{root}/cp").awaitTermination()
    got = sorted(map(tuple, sinks.read_folder(spark, f"{root}/out").select("id", "v").collect()))
    assert got == sorted((f"k{k}", max(i for i in range(60) if i % 7 == k)) for k in range(7))


def test_streamed_windows_equal_the_batch(spark, landed):
    df, folder, _ = landed
    got = _memory(S.tumbling_counts(S.file_stream(spark, folder, df.schema, 3), "at", ["id"]), "tumbling", "complete")
    want = df.groupBy(F.window("at", "1 day").alias("w"), "id").count().select("w.start", "id", "count")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    sessions = _memory(S.sessions(S.file_stream(spark, folder, df.schema, 3), "at", "id", gap="2 hours"), "sessions", "complete")
    assert sessions.agg(F.sum("n")).head()[0] == 60
    seen = _memory(S.first_deliveries(S.file_stream(spark, folder, df.schema, 3), "id", "at"), "first")
    assert seen.count() == 7
