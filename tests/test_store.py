"""A table of generations: what readers see when a commit ends anywhere, which files are written, and merges with their states."""

from __future__ import annotations

import pytest

from docspark.operators import merge
from docspark.sources import store

SCHEMA = "key string, note string, n int"


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def content(spark, path):
    return sorted(map(tuple, store.read(spark, path).collect()), key=str)


@pytest.mark.parametrize("kind", store.KINDS)
def test_only_touched_buckets_are_written(spark, tmp_path, kind):
    path = str(tmp_path / "t")
    assert store.read(spark, path) is None
    first = store.commit(rows(spark, *[(f"k{i}", "a", i) for i in range(40)], (None, None, None)), path, "key", None, buckets=8, kind=kind)
    again = store.newest(spark, path)
    assert again == first and len(content(spark, path)) == 41
    new = rows(spark, ("k3", "b", None))
    touched = store.touched_by(new, "key", 8)
    kept = store.read(spark, path, first, touched).where("key IS NULL OR key <> 'k3'")
    second = store.commit(kept.unionByName(new), path, "key", first, touched, kind=kind)
    assert len(touched) == 1 and [b for b in first.parts if first.parts[b] != second.parts[b]] == [str(touched[0])]
    got = content(spark, path)
    assert len(got) == 41 and ("k3", "b", None) in got and (None, None, None) in got


def test_a_commit_that_ends_anywhere_leaves_the_state_before(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    first = store.commit(rows(spark, ("a", "x", 1)), path, "key", None)
    before = content(spark, path)

    def stop(*_):
        raise KeyboardInterrupt

    for step in ("_files", "_publish", "asdict"):  # after the data, before the list, while the list is written
        with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
            m.setattr(store, step, stop)
            store.commit(rows(spark, ("a", "y", 2)), path, "key", first)
        assert content(spark, path) == before and store.newest(spark, path) == first
    (tmp_path / "t" / "_states" / "_half").write_text("{")
    assert content(spark, path) == before
    store.commit(rows(spark, ("a", "y", 2)), path, "key", first)
    assert content(spark, path) == [("a", "y", 2)]


def test_the_second_of_two_commits_fails(spark, tmp_path):
    path = str(tmp_path / "t")
    first = store.commit(rows(spark, ("a", "x", 1)), path, "key", None)
    store.commit(rows(spark, ("a", "y", 2)), path, "key", first)
    with pytest.raises(store.Conflict):
        store.commit(rows(spark, ("a", "z", 3)), path, "key", first)
    assert content(spark, path) == [("a", "y", 2)]


def test_clean_removes_what_no_recent_state_names(spark, tmp_path):
    path, state = str(tmp_path / "t"), None
    for n in range(4):
        state = store.commit(rows(spark, ("a", "x", n)), path, "key", state)
    assert store.clean(spark, path) == 0  # all are young
    assert store.clean(spark, path, keep=2, hours=-1.0) == 2
    assert content(spark, path) == [("a", "x", 3)] and len(list((tmp_path / "t" / "data").iterdir())) == 2


FIELDS = "key string, version int, note string, inner struct<a:string,b:int>, items array<struct<c:string>>"
OLD = [("same", 1, "x", ("p", 1), [("i",)]), ("fills", 1, " ", (None, 1), []), ("stays", 1, "x", None, None)]
NEW = [("same", 2, "x", ("p", 1), [("i",)]), ("fills", 2, "new", ("q", 2), [("j",)]), ("fresh", 2, "n", None, None), ("fresh", 3, "m", ("z", None), None)]


@pytest.mark.parametrize(("mode", "states", "note"), [
    ("fill", {"same": "unchanged", "fills": "updated", "stays": "kept", "fresh": "inserted"}, {"fills": "new", "fresh": "n"}),
    ("replace", {"same": "unchanged", "fills": "updated", "stays": "kept", "fresh": "inserted"}, {"fills": "new", "fresh": "m"}),
    ("only-new", {"same": "unchanged", "fills": "unchanged", "stays": "kept", "fresh": "inserted"}, {"fills": " ", "fresh": "n"}),
])
def test_merge_with_states(spark, mode, states, note):
    got = {r.key: r for r in merge.upsert(spark.createDataFrame(OLD, FIELDS), spark.createDataFrame(NEW, FIELDS), mode).collect()}
    assert {k: r.state for k, r in got.items()} == states
    assert {k: got[k].note for k in note} == note
    assert (got["fills"].inner.a, [tuple(i) for i in got["fills"].items]) == ((None, []) if mode == "only-new" else ("q", [("j",)]))
    none = spark.createDataFrame([], FIELDS)
    assert {r.state for r in merge.upsert(none, spark.createDataFrame(NEW, FIELDS), mode).collect()} == {"inserted"}
    assert {r.state for r in merge.upsert(spark.createDataFrame(OLD, FIELDS), none, mode).collect()} == {"kept"}
    assert merge.upsert(none, none, mode).collect() == []
