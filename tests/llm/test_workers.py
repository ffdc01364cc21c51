"""What a worker process holds from one stage to the next."""

import os

from trellisgraph.llm import wfst
from trellisgraph.llm.common import per_text


def _resident() -> float:
    """MB of this process."""
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / (1 << 20)


def _probe(spark, rows, of):
    """What a function gives in the worker of each task, as another operator's stage."""
    docs = spark.range(rows, numPartitions=rows).selectExpr("id", "'a text' AS text")

    def make():
        return lambda texts: {"value": [float(of()) for _ in texts]}

    return [r.value for r in per_text(docs, "value double", make, ["id"]).collect()]


def test_workers_forget_the_transducer_as_another_stage_begins(spark):
    docs = spark.range(32, numPartitions=16).selectExpr("id", "concat('some words of text ', id) AS text")
    assert wfst.encode(docs, ["id"]).where("n_tokens > 0").count() == 32

    def remembered():
        from trellisgraph.llm import wfst as loaded

        return loaded._loaded.cache_info().currsize

    assert set(_probe(spark, 16, remembered)) == {0}


def test_workers_return_what_a_task_freed(spark):
    docs = spark.range(1, numPartitions=1).selectExpr("id", "'a text' AS text")

    def make():
        import builtins

        def apply(texts):
            before = _resident()
            many = [bytes(4000) for _ in range(60_000)]
            builtins._pinned = many[::2000]  # the heap cannot shrink from its end
            held = _resident() - before
            return {"pid": [os.getpid()], "before": [before], "held": [held]}

        return apply

    first = per_text(docs, "pid bigint, before double, held double", make, ["id"]).collect()[0]
    assert first.held > 150

    def after():
        return _resident() if os.getpid() == first.pid else -1

    seen = [x for _ in range(3) for x in _probe(spark, 16, after) if x >= 0]
    assert seen and min(seen) < first.before + 80
