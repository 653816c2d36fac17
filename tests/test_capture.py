"""Change capture: nothing is lost, whatever order events come in; retries; dead letters."""

import pytest

from vectorloom.errors import InvalidArgument
from vectorloom.operators.collection import Config, Engine
from vectorloom.streaming import cdc

DOCS = cdc.Mapping("public.documents", "docs", "doc_id", "vector", "deleted_at IS NULL")


@pytest.fixture
def docs(spark, tmp_path):
    return Engine(spark, str(tmp_path / "engine")).create(Config("docs", 3))


def events(spark, rows):
    return spark.createDataFrame([(o, "public.documents", lsn, s, r, old) for o, lsn, s, r, old in rows], cdc.EVENT)


def row(i, v=None, **more):
    return {"doc_id": i, **({"vector": v} if v else {}), **more}


def state(c):
    return {r["id"]: r["values"] for r in c.snapshot().collect()}


def test_wrong_dimension_takes_no_other_event_along(spark, docs):
    dead = []
    cdc.apply_batch(events(spark, [
        ("insert", 1, 0, row("a", "[1,2,3]"), None), ("update", 2, 0, row("a", "[1,2]"), None), ("insert", 3, 0, row("b", "[1,2]"), None),
        ("update", 4, 0, row("c", note="no vector"), None), ("insert", 5, 0, {"vector": "[1,2,3]"}, None), ("drop", 6, 0, row("d"), None),
    ]), [DOCS], {"docs": docs}, lambda df: dead.extend(df.collect()))
    assert state(docs) == {"a": [1, 2, 3]}
    assert {(r["lsn"], r["error"]) for r in dead} == {(2, "wrong dimension"), (3, "wrong dimension"), (4, "no vector known"), (5, "no id"), (6, "unknown op")}


def test_late_and_split_transactions(spark, docs):
    both = {"docs": docs}
    cdc.apply_batch(events(spark, [("insert", 10, 0, row("a", "[1,1,1]"), None)]), [DOCS], both)
    late = events(spark, [("insert", 5, 0, row("b", "[5,5,5]"), None), ("update", 6, 0, row("a", "[6,6,6]"), None), ("insert", 10, 1, row("c", "[2,2,2]"), None)])
    assert cdc.apply_batch(late, [DOCS], both) == {"docs": 2}  # a was settled by the later event
    assert state(docs) == {"a": [1, 1, 1], "b": [5, 5, 5], "c": [2, 2, 2]}
    assert cdc.apply_batch(late, [DOCS], both) == {"docs": 0}
    cdc.apply_batch(events(spark, [("truncate", 7, 0, None, None)]), [DOCS], both)  # late: b and a's past are before it
    assert state(docs) == {"a": [1, 1, 1], "c": [2, 2, 2]}
    cdc.apply_batch(events(spark, [("insert", 4, 0, row("old", "[4,4,4]"), None)]), [DOCS], both)
    assert sorted(state(docs)) == ["a", "c"]
    cdc.apply_batch(events(spark, [("delete", 12, 0, row("a"), None), ("insert", 13, 0, row("e", "[3,3,3]", deleted_at="x"), None)]), [DOCS], both)
    assert sorted(state(docs)) == ["c"]


def test_metadata_is_kept(spark, docs):
    docs.upsert(spark.createDataFrame([("a", [1.0, 2.0, 3.0], {"k": "v"})], "id string, values array<float>, metadata map<string,string>"))
    cdc.apply_batch(events(spark, [("update", 1, 0, row("a", "[3,2,1]"), None)]), [DOCS], {"docs": docs})
    got = docs.snapshot().first()
    assert got["values"] == [3, 2, 1] and got["metadata"] == {"k": "v"}


def test_writer_retries_and_breaks(spark, docs, monkeypatch):
    calls, waits = [], []

    def flaky(events, mappings, collections, dead):
        calls.append(1)
        if len(calls) <= fail:
            raise OSError("gone")

    monkeypatch.setattr(cdc, "apply_batch", flaky)
    fail = 2
    w = cdc.Writer([DOCS], {"docs": docs}, sleep=waits.append)
    w.apply(None)
    assert len(calls) == 3 and 0.1 <= waits[0] <= 0.15 and 0.2 <= waits[1] <= 0.3 and w.applied == 1 and not w.pending
    calls.clear()
    fail = 99
    for _ in range(2):
        with pytest.raises(OSError):
            w.apply(None)
    with pytest.raises(cdc.CircuitOpen):
        w.flush()
    assert len(w.pending) == 2 and len(calls) == 15
    with pytest.raises(cdc.CircuitOpen):
        w.apply(None)
    assert len(calls) == 15


def test_stream_with_dead_letters(spark, docs, tmp_path):
    events(spark, [("insert", 1, 0, row("a", "[1,2,3]"), None), ("insert", 1, 1, row("b", "[1,2]"), None)]).write.parquet(f"{tmp_path}/feed/1")
    feed = cdc.read_events(spark, f"{tmp_path}/feed/*", 1)
    for _ in range(2):
        cdc.stream(feed, [DOCS], {"docs": docs}, f"{tmp_path}/check", f"{tmp_path}/dead", once=True).awaitTermination()
    assert sorted(state(docs)) == ["a"] and [r["error"] for r in spark.read.parquet(f"{tmp_path}/dead").collect()] == ["wrong dimension"]


def test_config_and_reconciler(spark, docs, tmp_path):
    (tmp_path / "sync.json").write_text('{"tables": [{"table": "public.documents", "collection": "docs", "id_column": "doc_id", "embedding_column": "vector", "filter": "deleted_at IS NULL"}]}')
    assert cdc.load_config(docs.engine, f"{tmp_path}/sync.json") == [DOCS]
    for wrong in ("[1]", "{", '{"tables": [], "x": 1}', '{"tables": [{"table": "a.b", "nope": 1}]}'):
        (tmp_path / "wrong.json").write_text(wrong)
        with pytest.raises((InvalidArgument, TypeError)):
            cdc.load_config(docs.engine, f"{tmp_path}/wrong.json")
    docs.upsert(spark.createDataFrame([("orphan", [1.0, 2.0, 3.0])], "id string, values array<float>"))
    source = spark.createDataFrame([("n", "[1,1,1]", None), ("bad", "[", None), ("off", "[1,1,1]", "x")], "doc_id string, vector string, deleted_at string")
    r = cdc.Reconciler(lambda: source, docs, DOCS, repairs=True)
    assert r.run() == {"missing": 1, "orphaned": 1, "malformed": 1, "repaired": 2}
    waits = []
    assert r.run_every(30, 2, waits.append)["passes"] == 3 and waits == [30] and r.counters["missing"] == 1 and sorted(state(docs)) == ["n"]
