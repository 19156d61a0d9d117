"""The result store: what readers see while writers write, die or meet."""

import pytest

from tidemark.plans.merge import RESULT_KEYS
from tidemark.sources import store as stores

COLUMNS = "track_id string, ClusterSize int, bias_tolerance double, gt_family string, cluster_id int, NSM double"


def rows(spark, *values):
    return spark.createDataFrame([(t, 18, 0.5, "gt1", k, v) for t, k, v in values], COLUMNS)


def held(store, generation=None):
    return sorted((r.track_id, r.cluster_id, r.NSM) for r in store.read(generation).collect())


@pytest.fixture
def store(spark, tmp_path):
    return stores.ResultStore(spark, str(tmp_path / "results"), COLUMNS, RESULT_KEYS)


def test_updates_replace_touched_tracks_only(spark, store, tmp_path):
    assert held(store) == [] and store.update(rows(spark)) == 0
    assert store.update(rows(spark, ("0129", 1, 1.0), ("0129", 2, 2.0), ("0204", 1, 3.0), ("a/b=c", 1, 4.0))) == 1
    assert store.update(rows(spark, ("0129", 2, 20.0), ("0129", 3, 30.0))) == 2
    assert held(store) == [("0129", 1, 1.0), ("0129", 2, 20.0), ("0129", 3, 30.0), ("0204", 1, 3.0), ("a/b=c", 1, 4.0)]
    assert held(store, 1) == [("0129", 1, 1.0), ("0129", 2, 2.0), ("0204", 1, 3.0), ("a/b=c", 1, 4.0)] and held(store, 0) == []
    second = next((tmp_path / "results").glob("data-2-*"))
    assert [p.name for p in second.iterdir() if p.is_dir()] == ["track=0129"]  # the other tracks are not written again
    with pytest.raises(ValueError):
        store.update(rows(spark, (None, 1, 1.0)))


def test_a_writer_that_dies_changes_nothing(spark, store, tmp_path, monkeypatch):
    store.update(rows(spark, ("0129", 1, 1.0)))
    with monkeypatch.context() as m:
        m.setattr(store, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            store.update(rows(spark, ("0129", 1, 99.0)))
    assert held(store) == [("0129", 1, 1.0)] and len(list((tmp_path / "results").glob("data-*"))) == 2
    (tmp_path / "results" / "manifest" / "2.json").write_text('{"tracks": {"0129"')  # cut off
    assert held(store) == [("0129", 1, 1.0)]
    with pytest.raises(ValueError):
        store.read(2)
    assert store.update(rows(spark, ("0129", 1, 5.0))) == 3 and held(store) == [("0129", 1, 5.0)]
    gone = store.vacuum(keep=1)
    assert len(gone) == 2 and held(store) == [("0129", 1, 5.0)] and len(list((tmp_path / "results").glob("data-*"))) == 1


def test_writers_that_meet(spark, store, monkeypatch):
    store.update(rows(spark, ("0129", 1, 1.0)))
    other = stores.ResultStore(spark, store.folder, COLUMNS, RESULT_KEYS)
    commit, met = store._commit, []

    def late(base, tracks):
        if not met:
            met.append(other.update(rows(spark, ("0129", 2, 2.0), ("0204", 1, 7.0))))
        return commit(base, tracks)

    monkeypatch.setattr(store, "_commit", late)
    assert store.update(rows(spark, ("0129", 1, 10.0))) == 3 and met == [2]
    assert held(store) == [("0129", 1, 10.0), ("0129", 2, 2.0), ("0204", 1, 7.0)]
    monkeypatch.setattr(store, "_commit", lambda *a: 0)
    with pytest.raises(stores.Conflict):
        store.update(rows(spark, ("0129", 1, 11.0)), attempts=2)
    assert held(store) == [("0129", 1, 10.0), ("0129", 2, 2.0), ("0204", 1, 7.0)]


def test_a_writer_overtaken_before_its_manifest_was_whole(spark, store, tmp_path, monkeypatch):
    store.update(rows(spark, ("0129", 1, 1.0)))
    other = stores.ResultStore(spark, store.folder, COLUMNS, RESULT_KEYS)
    system, path = store._path("manifest/2.json")
    system.create(path, False).close()  # as far as a slow writer has come
    assert other.update(rows(spark, ("0204", 1, 7.0))) == 3
    (tmp_path / "results" / "manifest" / ".2.json.crc").unlink(missing_ok=True)
    (tmp_path / "results" / "manifest" / "2.json").write_text('{"base": 1, "tracks": {}, "whole": true}')
    newest = store.latest()[0]
    while newest > 2:
        newest = store._manifest(newest)["base"]
    assert newest == 1 and held(store) == [("0129", 1, 1.0), ("0204", 1, 7.0)]
