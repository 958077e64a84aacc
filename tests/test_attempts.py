"""Items worked on over several runs of a stream: finished ones never again, others go on where they were."""

from claimspark.streaming.attempts import outcomes, work_through


def test_resumes_where_it_stopped(spark, tmp_path):
    source, out, checkpoint, calls = (f"{tmp_path}/{x}" for x in ("in", "out", "checkpoint", "calls"))

    def work(item, attempt):
        with open(calls, "a") as f:
            f.write(f"{item}:{attempt}\n")
        if item == "never" or (item == "late" and attempt < 3):
            raise OSError("down")
        return f"{item}!{attempt}"

    def deliver(*items):
        spark.createDataFrame([(x,) for x in items], "item string").coalesce(1).write.mode("append").parquet(source)
        work_through(spark, spark.readStream.schema("item string").parquet(source), "item", work, out, checkpoint)
        return {r.item: (r.tries, r.status, r.deliveries, r.answer) for r in outcomes(spark, out, "item").collect()}

    first = deliver("now", "now", "late", "never")
    assert first == {"now": (1, "done", 2, "now!1"), "late": (1, "open", 1, None), "never": (1, "open", 1, None)}
    second = deliver("now", "late", "late", "late", "never", "never", "never")  # a new stream over the old checkpoint
    assert second == {"now": (1, "done", 3, "now!1"), "late": (3, "done", 4, "late!3"), "never": (3, "failed", 4, None)}
    with open(calls) as f:
        assert sorted(f.read().split()) == ["late:1", "late:2", "late:3", "never:1", "never:2", "never:3", "now:1"]
