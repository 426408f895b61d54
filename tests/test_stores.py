import pytest
from pyspark.sql import DataFrame

from seqspan.operators import stores


@pytest.fixture
def project(spark):
    def make(name, key=1, order=1, reason="ok", models=(1,), fp=10.0, contrast=0.9):
        rows = lambda data, schema: spark.createDataFrame(data, schema)
        return {
            "gate": rows([(key, name, reason)], "key long, project string, reason string"),
            "contrast": rows([(key, name, "on", p, contrast) for p in range(12)], "key long, project string, kind string, pixel long, contrast double"),
            "results": rows([(key, m, name, 0.9, 0, True, order) for m in models], "key long, model long, project string, good double, false long, fit boolean, order long"),
            "cards": rows([(key, name, order, [fp] * 3)], "key long, project string, order long, fp array<double>"),
            "onsets": rows([(key, name, order, 0, 1.5, [fp] * 3)], "key long, project string, order long, side long, offset double, fp array<double>"),
        }

    return make


def state(spark, folder):
    return {name: sorted(map(str, df.collect())) for name, df in stores.opened(spark, folder, stores.LEARNING).items()}


def test_projects_teach_all_stores_at_once(spark, tmp_path, project):
    folder = str(tmp_path / "stores")
    assert all(not rows for rows in state(spark, folder).values())
    assert stores.learn_projects(spark, folder, "a1", **project("a"))
    first = stores.opened(spark, folder, stores.LEARNING)
    # no mask was held: nothing is recorded, and the new one is in use
    assert [(r.model, r.current) for r in first["masks"].collect()] == [(1, True)] and first["records"].isEmpty()
    assert stores.learn_projects(spark, folder, "b1", **project("b", order=2, models=(1, 9), fp=50.0))
    now = stores.opened(spark, folder, stores.LEARNING)
    assert sorted((r.model, r.place, r.current) for r in now["masks"].collect()) == [(1, 0, True), (2, -1, False)]
    assert [(r.model, r.project) for r in now["records"].collect()] == [(1, "b")]  # mask 9 isn't held
    assert sorted(r.order for r in now["cards"].collect()) == [1, 2]
    assert sorted(r.project for r in now["markers"].collect()) == ["a", "b"]
    # the same correction again changes nothing, another one of the same project replaces what it taught
    before = state(spark, folder)
    assert not stores.learn_projects(spark, folder, "b1", **project("b", order=2, fp=70.0)) and state(spark, folder) == before
    assert stores.learn_projects(spark, folder, "b2", **project("b", order=3, fp=52.0))
    again = stores.opened(spark, folder, stores.LEARNING)
    assert sorted((r.project, r.order, r.fp[0]) for r in again["markers"].collect()) == [("a", 1, 10.0), ("b", 3, 52.0)]
    assert sorted(r.order for r in again["cards"].collect()) == [1, 3]  # the card close to the new one made way


def test_projects_that_fail_the_gate_teach_nothing(spark, tmp_path, project):
    folder = str(tmp_path / "stores")
    assert stores.learn_projects(spark, folder, "x", **project("x", reason="too much"))
    assert all(not rows for rows in state(spark, folder).values())


@pytest.mark.parametrize("last", [1, 4])
def test_a_failure_between_stores_leaves_all_as_they_were(spark, tmp_path, project, monkeypatch, last):
    folder = str(tmp_path / "stores")
    stores.learn_projects(spark, folder, "a1", **project("a"))
    before = state(spark, folder)
    writes = []
    write = type(spark.range(1).write).parquet

    def broken(self, path, *more, **options):
        if path.startswith(folder):
            writes.append(path)
            if len(writes) > last:
                raise OSError("the store is gone")
        return write(self, path, *more, **options)

    monkeypatch.setattr(type(spark.range(1).write), "parquet", broken)
    with pytest.raises(OSError, match="gone"):
        stores.learn_projects(spark, folder, "b1", **project("b", order=2))
    monkeypatch.undo()
    assert len(writes) == last + 1 and state(spark, folder) == before and stores.committed(spark, folder) == ["a1"]
    assert stores.learn_projects(spark, folder, "b1", **project("b", order=2))
    assert stores.committed(spark, folder) == ["a1", "b1"] and state(spark, folder) != before


def test_oldest_projects_go(spark, tmp_path, project):
    folder = str(tmp_path / "stores")
    for n in range(4):
        stores.learn_projects(spark, folder, f"t{n}", **project(f"p{n}", order=n, fp=40.0 * n), keep_projects=2, keep_cards=3)
    now = stores.opened(spark, folder, stores.LEARNING)
    assert isinstance(now["markers"], DataFrame) and sorted(r.project for r in now["markers"].collect()) == ["p2", "p3"]
    assert sorted(r.order for r in now["cards"].collect()) == [1, 2, 3]


def test_an_unfinished_manifest_is_passed_by(spark, tmp_path, project):
    folder = str(tmp_path / "stores")
    stores.learn_projects(spark, folder, "a1", **project("a"))
    (tmp_path / "stores/manifest/n=1/_temporary").mkdir(parents=True)
    assert stores.committed(spark, folder) == ["a1"]
    assert stores.learn_projects(spark, folder, "b1", **project("b", order=2)) and stores.committed(spark, folder) == ["a1", "b1"]
