import json
import os

import pytest

from ledgerloom.config import RunConfig
from ledgerloom.plans.pipeline import named
from ledgerloom.sources import named as m


@pytest.fixture
def save(spark, tmp_path):
    m.register(spark)

    def run(rows, mode="append", parts=2):
        df = spark.createDataFrame(rows, "name string, content string").repartition(parts)
        df.write.format("ledgerloom_files").mode(mode).option("path", str(tmp_path / "o")).save()

    return run


def there(tmp_path):
    top = tmp_path / "o"
    return {p.name: p.read_text() for p in top.iterdir() if p.is_file()} if top.exists() else {}


def test_files_by_name(save, tmp_path):
    save([("a.json", "1"), ("b.json", "2"), ("c.json", None)])
    save([("b.json", "é"), ("d.json", "4")])
    save([], parts=1)
    assert there(tmp_path) == {"a.json": "1", "b.json": "é", "c.json": "", "d.json": "4"}
    assert not os.listdir(tmp_path / "o/_staging")


@pytest.mark.parametrize("bad", ["", "x/y", "_x", ".x", None, "a.json"])
def test_a_run_that_fails_leaves_nothing(save, tmp_path, bad):
    save([("a.json", "old")])
    with pytest.raises(Exception, match="name"):  # noqa: PT011
        save([("a.json", "new"), ("n.json", "new"), (bad, "new")], parts=1)
    assert there(tmp_path) == {"a.json": "old"} and not os.listdir(tmp_path / "o/_staging")
    with pytest.raises(Exception, match="append"):  # noqa: PT011
        save([("a.json", "new")], "overwrite")
    assert there(tmp_path) == {"a.json": "old"}


def test_a_run_killed_while_it_moves_is_finished(save, tmp_path):
    """One that was committed is; one that was not is left out of sight."""
    for run, mark in (("killed-early", False), ("killed-late", True)):
        stage = tmp_path / "o/_staging" / run
        (stage / "0-1").mkdir(parents=True)
        (stage / "0-1" / f"{run}.json").write_text("whole")
        (stage / "0-2").mkdir()
        (stage / "0-2" / "lost.json").write_text("an attempt that did not win")
        if mark:
            (stage / "_committed").write_text(json.dumps([str(stage / "0-1"), str(stage / "gone")]))
    save([("a.json", "1")])
    assert there(tmp_path) == {"a.json": "1", "killed-late.json": "whole"}


def test_names_that_clash_are_told_apart(spark):
    schema = "symbol string, form string, accession string, document string, collection string, summaries array<string>"
    rows = [("A", "10-K", "1", d, "c", ["s"]) for d in ("x.htm", "x.html", "y.htm", "z" * 130 + "1.htm", "z" * 130 + "2.htm")]
    got = sorted(r.name for r in named(spark.createDataFrame(rows, schema), RunConfig(keyword="k")).collect())
    assert len(set(got)) == 5 and "a_k_1_y.summary.json" in got and sum(n.startswith("a_k_1_x_") for n in got) == 2
    assert all(n.endswith(".summary.json") for n in got)


def test_many_small_files_are_read_by_few_tasks(save, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(m, "TASKS", 1)
    rows = [(f"n {i}.json", f"é\n{i}") for i in range(700)]
    save(rows, parts=3)
    back = m.read_files(spark, str(tmp_path / "o"))
    assert back.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert sorted(map(tuple, back.collect())) == sorted(rows) and not os.listdir(tmp_path / "o/_staging")
