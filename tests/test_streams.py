"""Streams that stop, fail and go on."""

import os

import pytest

from tablewarden.sources import log
from tablewarden.streaming import changes
from tablewarden.sources.state import KeyedState

LOG = "seq long, entity_type string, entity_urn string, aspect_name string, change_type string, aspect_json string"


def event(seq, entity="e0", kind="UPSERT", payload='{"a":"1"}', aspect="status"):
    return (seq, "dataset", entity, aspect, kind, payload)


def append(spark, folder, rows):
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(str(folder))


def plain(df):
    return sorted(map(tuple, df.collect()), key=str)


def written(root):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}


def test_state_goes_on_after_a_restart(spark, tmp_path):
    source, root = tmp_path / "log", str(tmp_path / "state")
    every = [event(i, f"e{i % 7}", "DELETE" if i % 5 == 0 else "PATCH" if i % 11 == 0 else "UPSERT") for i in range(1, 60)] + [event(60, None)]
    for k in range(0, 60, 10):  # a run for each file: each run is a restart
        append(spark, source, every[k : k + 10])
        got = changes.latest_state(log.change_log_stream(spark, str(source), LOG), root, buckets=4, most_parts=3)
        assert plain(got) == plain(log.aspect_snapshot(spark.createDataFrame(every[: k + 10], LOG)))
    append(spark, source, [event(0, "e1"), event(2, "e2", "DELETE")])  # late ones change nothing
    got = changes.latest_state(log.change_log_stream(spark, str(source), LOG), root, buckets=4, most_parts=3)
    assert plain(got) == plain(log.aspect_snapshot(spark.createDataFrame(every, LOG)))


def state(spark, root, **sizes):
    schema = spark.createDataFrame([], LOG).schema
    return KeyedState(spark, str(root), schema, ["entity_urn", "aspect_name"], "seq", **sizes)


def test_what_a_batch_writes_follows_the_batch(spark, tmp_path):
    held = state(spark, tmp_path, buckets=8, most_parts=50)
    held.merge(spark.createDataFrame([event(i, f"e{i}", payload="x" * 300 + str(i)) for i in range(20_000)], LOG), 0)
    before = written(tmp_path)
    held.merge(spark.createDataFrame([event(30_000, "e5"), event(30_001, "e6")], LOG), 1)
    new = written(tmp_path)
    assert set(before) <= set(new)
    assert sum(new[f] for f in set(new) - set(before)) < 0.05 * sum(before.values())
    assert held.rows().count() == 20_000 and held.rows().where("entity_urn = 'e5'").first()["seq"] == 30_000


def test_a_batch_counts_once_and_a_failed_one_not_at_all(spark, tmp_path, monkeypatch):
    held = state(spark, tmp_path)
    held.merge(spark.createDataFrame([event(5, "a")], LOG), 0)
    held.merge(spark.createDataFrame([event(9, "a"), event(9, "b")], LOG), 0)  # delivered again
    assert plain(held.rows().select("entity_urn", "seq")) == [("a", 5)]

    def fail(*_):
        raise OSError("store is away")

    with monkeypatch.context() as m:
        m.setattr(held.files, "publish", fail)
        with pytest.raises(OSError):
            held.merge(spark.createDataFrame([event(7, "c")], LOG), 1)
    again = state(spark, tmp_path)
    assert plain(again.rows().select("entity_urn", "seq")) == [("a", 5)]
    again.merge(spark.createDataFrame([event(7, "c")], LOG), 1)
    assert plain(again.rows().select("entity_urn", "seq")) == [("a", 5), ("c", 7)]


def test_full_buckets_are_merged_and_old_parts_go(spark, tmp_path):
    held = state(spark, tmp_path, buckets=1, most_parts=4)
    for n in range(9):
        held.merge(spark.createDataFrame([event(n, "a"), event(n, f"k{n}")], LOG), n)
    assert max(len(p) for p in held.pointer()["parts"].values()) < 4
    assert len(held.files.names(f"{tmp_path}/pointers")) == 2
    assert held.rows().count() == 10 and held.rows().where("entity_urn = 'a'").first()["seq"] == 8
    listed = {p for parts in held.pointer()["parts"].values() for p in parts}
    assert len({os.path.dirname(f) for f in written(tmp_path)}) <= 2 * len(listed) + 4


def shout(event):
    if event["aspect"].get("fail") == "always":
        raise ValueError(event["seq"])
    return event["aspect"]["a"].upper()


def test_bad_events_do_not_stop_the_others(spark, tmp_path):
    source, root = tmp_path / "log", str(tmp_path / "out")
    rows = [event(1, payload='{"a":"x"}'), event(2, payload='{"fail":"always"}'), event(3, payload="{"), event(4, None), event(5, aspect=None), event(6, payload=None), event(7, payload="{}")]
    append(spark, source, rows)
    got = changes.isolate(log.change_log_stream(spark, str(source), LOG), shout, root)
    want = [(1, "handled", "X", None), (2, "dead", None, "handler: ValueError"), (3, "dead", None, "unreadable aspect"), (4, "dead", None, "no entity"), (5, "dead", None, "no aspect"), (6, "dead", None, "unreadable aspect"), (7, "dead", None, "handler: KeyError")]
    assert plain(got.select("seq", "sink", "result", "reason")) == want
    append(spark, source, [event(8, payload='{"a":"y"}'), event(9, payload='{"fail":"always"}')])
    got = changes.isolate(log.change_log_stream(spark, str(source), LOG), shout, root)  # a restart
    assert plain(got.select("seq", "sink", "result", "reason")) == want + [(8, "handled", "Y", None), (9, "dead", None, "handler: ValueError")]


def test_a_batch_delivered_again_is_there_once(spark, tmp_path):
    source, root = tmp_path / "log", str(tmp_path / "out")
    append(spark, source, [event(1, payload='{"a":"x"}'), event(2, payload="{")])
    first = plain(changes.isolate(log.change_log_stream(spark, str(source), LOG), shout, root))
    commit = [os.path.join(root, "offsets/commits", f) for f in os.listdir(os.path.join(root, "offsets/commits"))]
    for f in commit:  # as if the driver was lost before the batch was acknowledged
        os.remove(f)
    assert plain(changes.isolate(log.change_log_stream(spark, str(source), LOG), shout, root)) == first


def test_a_handler_is_tried_again(spark, tmp_path):
    rows = spark.createDataFrame([event(1, payload=f'{{"file":"{tmp_path / "tried"}"}}')], LOG)

    def second_time(event):
        import pathlib

        file = pathlib.Path(event["aspect"]["file"])
        if not file.exists():
            file.touch()
            raise OSError("not yet")
        return "done"

    assert [r["result"] for r in changes.handled(rows, second_time, 2).collect()] == ["done"]
    assert [r["reason"] for r in changes.handled(rows, lambda e: 1 / 0, 3).collect()] == ["handler: ZeroDivisionError"]
