"""The message log: exactly-once appends, offsets, restart, abort."""

import os

import pytest

from tidewatch.sources.message_log import FORMAT, LogStreamReader, LogStreamWriter, MessageLog, _File, _Folder, append_once


def _msgs(spark, lo, hi):
    return spark.range(lo, hi).selectExpr("cast(id as string) as key", "concat('{\"n\": ', id, '}\\n') as value")


def _keys(spark, path):
    return sorted(int(r.key) for r in spark.read.format(FORMAT).load(path).collect())


def test_appends_under_one_id_add_once(spark, tmpdir_fresh):
    append_once(_msgs(spark, 0, 100).repartition(4), tmpdir_fresh, "a-1")
    append_once(_msgs(spark, 0, 100).repartition(2), tmpdir_fresh, "a-1")
    append_once(_msgs(spark, 100, 100), tmpdir_fresh, "a-2")  # an empty commit
    append_once(_msgs(spark, 100, 150), tmpdir_fresh, "a-11")
    assert _keys(spark, tmpdir_fresh) == list(range(150))
    assert spark.read.format(FORMAT).load(tmpdir_fresh).filter("key = 7").first().value == '{"n": 7}\n'
    kept = {f["name"] for c in _Folder(tmpdir_fresh).commits() for f in _Folder(tmpdir_fresh).files(c)}
    assert kept == set(os.listdir(os.path.join(tmpdir_fresh, "data")))  # files of a repeated commit are gone
    with pytest.raises(Exception, match="only appended"):
        _msgs(spark, 0, 1).write.format(FORMAT).mode("overwrite").save(tmpdir_fresh)


def test_stream_source_and_sink_across_a_restart(spark, tmpdir_fresh):
    spark.dataSource.register(MessageLog)
    a, b, ck = (os.path.join(tmpdir_fresh, x) for x in ("a", "b", "ck"))
    append_once(_msgs(spark, 0, 30).repartition(3), a, "p0")

    def run():
        q = (spark.readStream.format(FORMAT).load(a).writeStream.format(FORMAT).option("path", b).option("writer", "copy")
             .option("checkpointLocation", ck).trigger(availableNow=True).start())
        assert q.awaitTermination(300)

    run()
    append_once(_msgs(spark, 30, 50), a, "p1")
    run()
    run()  # nothing new
    assert _keys(spark, b) == list(range(50))


def test_a_batch_run_again_gives_no_second_message(tmpdir_fresh):
    folder = _Folder(tmpdir_fresh)

    def batch(n, rows):
        w = LogStreamWriter(folder, "q")
        parts = [w.write(iter(rows[i::2])) for i in range(2)]
        return w, parts

    w, parts = batch(0, [("k0", "v"), ("k1", "v")])
    w.abort(parts, 0)  # a failed attempt leaves nothing
    assert os.listdir(os.path.join(tmpdir_fresh, "data")) == []
    for _ in range(2):
        w, parts = batch(0, [("k0", "v"), ("k1", "v")])
        w.commit(parts, 0)
    w, parts = batch(1, [("k2", "v")])
    w.commit(parts, 1)
    r = LogStreamReader(folder, "earliest")
    assert r.initialOffset() == {"commits": 0} and r.latestOffset() == {"commits": 2}
    assert LogStreamReader(folder, "latest").initialOffset() == {"commits": 2}
    read = lambda s, e: sorted(k for p in r.partitions({"commits": s}, {"commits": e}) for k, _ in r.read(p))
    assert read(0, 1) == ["k0", "k1"] and read(1, 2) == ["k2"] and read(2, 2) == []
    assert isinstance(r.partitions({"commits": 0}, {"commits": 1})[0], _File)
