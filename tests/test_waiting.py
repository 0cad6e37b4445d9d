"""Requests that wait in state for a push, and time out by the clock."""

import time

from weftline.streaming import waiting

PUSH = "uri string, push_seq long, diagnostics string"
ASK = "uri string, request_id string, newer_than long, timeout_ms long"


def test_each_request_is_answered_once(spark, tmp_path):
    def put(folder, schema, *rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / folder))

    put("push", PUSH, ("a", 3, "[3]"), ("a", 5, "[5]"), ("b", 1, "[1]"))
    put("ask", ASK, ("a", "at once", 4, 60_000), ("a", "waits", 5, 60_000), ("b", "times out", 1, 1_000), ("c", "nothing", -1, 1_000), ("a", "no time", 9, 0))
    read = lambda folder, schema: spark.readStream.schema(schema).parquet(str(tmp_path / folder))
    stream = waiting.answers(read("push", PUSH), read("ask", ASK))
    query = stream.writeStream.format("memory").queryName("answers").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
    got = lambda: {r["request_id"]: (r["uri"], r["push_seq"], r["diagnostics"], r["fresh"]) for r in spark.table("answers").collect()}

    def until(n):
        end = time.monotonic() + 90
        while spark.table("answers").count() < n and time.monotonic() < end and query.isActive:
            time.sleep(0.3)
        assert query.isActive, query.exception()
        return got()

    try:
        first = until(4)
        assert first == {"at once": ("a", 5, "[5]", True), "no time": ("a", 5, "[5]", False), "times out": ("b", 1, "[1]", False), "nothing": ("c", None, None, False)}
        put("push", PUSH, ("a", 4, "[4]"))  # older than what is known
        put("push", PUSH, ("a", 8, "[8]"), ("b", 2, "[2]"))
        put("ask", ASK, ("b", "later", 1, 60_000))
        assert until(6) == first | {"waits": ("a", 8, "[8]", True), "later": ("b", 2, "[2]", True)}
        time.sleep(1.5)
        assert spark.table("answers").count() == 6
    finally:
        query.stop()


def test_a_session_with_the_default_state_store_answers_too(spark):
    from tests.duck import SF, assert_same, connect
    from weftline import catalog

    before, default = spark.conf.get(waiting.PROVIDER), "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    spark.conf.set(waiting.PROVIDER, default)
    try:
        assert_same(connect(), catalog.queries()["st3_answered_requests"](spark, SF), catalog.oracle_sql()["st3_answered_requests"])
        assert spark.conf.get(waiting.PROVIDER) == default
    finally:
        spark.conf.set(waiting.PROVIDER, before)
