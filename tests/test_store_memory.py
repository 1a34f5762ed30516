import pytest
from pyspark.sql import functions as F

from reviewlab.operators import retrieval as RT
from reviewlab.sources import vector_store as VS
from reviewlab.streaming import jobs as ST

CHUNKS = "doc_id long, chunk_no int, text string, label int"


def rows(spark, some):
    return spark.createDataFrame(some, CHUNKS)


def held(df):
    return {(r.doc_id, r.chunk_no): (r.text, r.label, r[VS.VERSION]) for r in df.collect()}


def test_only_new_or_changed_chunks_are_embedded(spark, tmp_path):
    store = VS.VectorStore(spark, f"file://{tmp_path}/store")
    assert store.snapshot() is None and store.versions() == []
    base = [(i, 0, f"text number {i}", 0) for i in range(200)] + [(200, 0, None, 1), (None, 1, "no key", 0)]
    assert store.upsert(rows(spark, base), RT.embed) == {"version": 1, "embedded": 202, "moved": 0, "removed": 0}
    first = store.snapshot()
    changed = [(5, 0, "another text", 0), (6, 0, "text number 6", 9), (7, 0, "text number 7", 0), (300, 0, "new", 1), (300, 0, "new", 1)]
    asked = []

    def embed(df):
        out = RT.embed(df)
        asked.append(df)
        return out
    assert store.upsert(rows(spark, changed), embed) == {"version": 2, "embedded": 2, "moved": 1, "removed": 0}
    assert len(held(first)) == 202 and held(first)[5, 0][0] == "text number 5"  # a reader keeps its snapshot
    now = held(store.snapshot())
    assert now[5, 0] == ("another text", 0, 2) and now[6, 0] == ("text number 6", 9, 2) and now[7, 0][2] == 1 and now[None, 1][2] == 1 and len(now) == 203
    assert store.upsert(rows(spark, changed), RT.embed) == {"version": 2, "embedded": 0, "moved": 0, "removed": 0}
    left = [r for r in base if r[0] != 9]
    assert store.upsert(rows(spark, left), RT.embed, remove_missing=True) == {"version": 3, "embedded": 1, "moved": 1, "removed": 2}
    now = held(store.snapshot())
    assert (9, 0) not in now and (300, 0) not in now and now[5, 0][0] == "text number 5" and len(now) == 201
    assert store.compact() == 4 and held(store.snapshot()) == now and len(store.folders(4)) == 1
    assert held(store.snapshot(1)) == held(first)
    vectors = {(r.doc_id, r.chunk_no): r.embedding for r in store.snapshot().collect()}
    fresh = {(r.doc_id, r.chunk_no): r.embedding for r in RT.embed(rows(spark, left)).collect()}
    assert vectors == fresh


def test_a_version_is_made_once(spark, tmp_path):
    one, two = (VS.VectorStore(spark, f"file://{tmp_path}/store") for _ in range(2))
    one.upsert(rows(spark, [(1, 0, "a", 0)]), RT.embed)
    with pytest.raises(VS.Conflict):
        two._publish(1, ["x"])
    assert len(held(two.snapshot())) == 1


TURNS = "conv_id long, turn long, role string, text string"


def test_memory_over_runs_and_replays(spark, tmp_path):
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", f"c{c} t{t}" if (c + t) % 7 else None) for c in range(6) for t in range(c + 1)] + [(None, 0, "user", "x"), (1, None, "user", "y")]
    work = f"file://{tmp_path}/work"

    def land(some):
        spark.createDataFrame(some, TURNS).repartition(2).write.mode("append").parquet(f"{work}/in")
    chunks = RT.packed_chunks(RT.embed(spark.createDataFrame([(1, 0, "c5 t4"), (2, 0, "other words")], "doc_id long, chunk_no int, text string")))
    land([t for t in turns if t[1] is None or t[1] < 2])
    first = ST.stream_conversations(spark, f"{work}/in", work, chunks, k=1).count()
    land([t for t in turns if t[1] is not None and t[1] >= 2])
    land([t for t in turns if t[1] in (0, 1)])  # arrives again
    out = ST.stream_conversations(spark, f"{work}/in", work, chunks, k=1).collect()
    good = [t for t in turns if t[0] is not None and t[1] is not None]
    assert first == sum(t[1] < 2 for t in good) and len(out) == len(good)
    want = {(r.conv_id, r.turn): (r.history, r.n_prev) for r in RT.chat_history(spark.createDataFrame(good, TURNS)).collect()}
    assert {(r.conv_id, r.turn): (r.history, r.n_prev) for r in out} == want
    hits = {(r.conv_id, r.turn): r.hits for r in out}
    assert hits[5, 4][0].doc_id == 1 and hits[5, 1] is None


def test_idle_conversations_are_forgotten():
    class State:
        exists, hasTimedOut, removed = True, True, False
        def remove(self):
            self.removed = True
    state = State()
    assert list(ST.remembering(5)((1,), iter([]), state)) == [] and state.removed
