"""Browsing with breadcrumbs and a way back, and snapshots that are read where they differ."""

import pytest
from models import RDF, grid_of, thing
from pyspark.sql import functions as F

from gridweft import cli
from gridweft.operators import browse
from gridweft.operators.access import Grid
from gridweft.operators.diff import diff_status
from gridweft.operators.snapshots import changed_parts, write_snapshot


@pytest.fixture(scope="module")
def ring(spark):
    """Three objects in a ring, one of which also leads out and to nothing."""
    parts = thing("A", "1", {}, {"x": "2"}) + thing("B", "2", {"p": "t"}, {"y": "3", "z": "4", "w": "9"}) + thing("C", "3", {}, {"x": "1", "y": "4"}) + thing("D", "4")
    return grid_of(spark, RDF.format(parts))


def test_paths_end_in_cycles(ring):
    rows = browse.paths(ring, F.col("id") == "_1", 10).collect()
    got = {r["id"]: (r["distance"], r["parent"], r["pick"], r["crumb"], r["picks"]) for r in rows}
    assert len(rows) == 4
    assert got == {"_1": (0, None, None, "A", ""), "_2": (1, "_1", 1, "A -> B", "1"), "_3": (2, "_2", 1, "A -> B -> C", "1,1"), "_4": (2, "_2", 2, "A -> B -> D", "1,2")}
    several = browse.paths(ring, F.col("id").isin("_1", "_3"), 1).collect()
    assert {(r["id"], r["distance"], r["crumb"]) for r in several} == {("_1", 0, "A"), ("_3", 0, "C"), ("_2", 1, "A -> B"), ("_4", 1, "C -> D")}
    assert browse.paths(ring, F.col("id") == "_7", 3).collect() == []


@pytest.mark.parametrize(
    ("commands", "want"),
    [
        ([1, 1, 1], ("_1", "A -> B -> C -> A", 4, None)),
        ([1, 2, 1], ("_4", "A -> B -> D", 3, "no references")),
        ([1, 2, "b", 1], ("_3", "A -> B -> C", 3, None)),
        (["b"], ("_1", "A", 1, "already at root")),
        ([7], ("_1", "A", 1, "no such reference")),
        ([1, 3, "b", 1], ("_9", "A -> B", 2, "not found")),
        ([], ("_1", "A", 1, None)),
    ],
)
def test_sessions(ring, commands, want):
    row = browse.sessions(ring, F.col("id") == "_1", commands).first()
    assert (row["id"], row["crumb"], row["depth"], row["note"]) == want


def test_browsing_by_hand(ring, capsys):
    answers = iter(["1", "x", "2", "1", "b", "b", "b", "1", "q"])
    assert cli._browse(ring, "_1", lambda: next(answers)) == 0
    out = capsys.readouterr().out
    crumbs = [line for line in out.splitlines() if set(line.split(" -> ")) <= {*"ABCD"}]
    assert crumbs == ["A", "A -> B", "A -> B", "A -> B -> D", "A -> B -> D", "A -> B", "A", "A", "A -> B"]
    assert "|  2  |    z: #_4" in out and "Already at root" in out and "No references" in out and "Pick 1-3" in out
    assert cli._browse(ring, "_9") == 1


def test_equal_buckets_are_not_read(spark, tmp_path):
    """One change in 200 objects: few buckets are read; differences are those of the whole versions."""
    objects = [thing("A" if i % 3 else "B", str(i), {"p": str(i), "q": "x"}, {"r": str(i + 1)}) for i in range(200)]
    changed = [*objects[:50], thing("A", "50", {"q": "x", "p": "new"}, {"r": "51"}), *objects[51:120], *objects[121:], thing("C", "300", {"p": "1"})]
    # Another order of objects and of an object's names is no difference.
    moved = thing("A", "7", {"q": "x", "p": "7"}, {"r": "8"})
    old, new = grid_of(spark, RDF.format("".join(objects))), grid_of(spark, RDF.format("".join([moved, *reversed([o for o in changed if 'ID="_7"' not in o])])))
    a, b = write_snapshot(old, f"{tmp_path}/a", 32), write_snapshot(new, f"{tmp_path}/b", 32)
    left, right = changed_parts(a, b)
    assert "PartitionFilters: [bucket" in left.triples._jdf.queryExecution().executedPlan().toString()
    assert left.objects.count() + right.objects.count() < 60
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(diff_status(left, right)) == rows(diff_status(old, new)) == [("m0", "A", "_50", "changed"), ("m0", "B", "_120", "removed"), ("m0", "C", "_300", "added")]
    same = changed_parts(a, a)
    assert same[0].objects.count() == 0 and diff_status(*same).isEmpty()
    nothing = write_snapshot(Grid(old.objects.where("false"), old.triples.where("false")), f"{tmp_path}/c", 32)
    assert diff_status(*changed_parts(nothing, b)).count() == 200
    with pytest.raises(ValueError, match="numbers of buckets"):
        changed_parts(a, write_snapshot(new, f"{tmp_path}/d", 8))


def test_tables_by_name(spark):
    """A stored table by a column lists the folders of the selected values alone; an empty text stays one."""
    from gridweft.storage import stored

    table = stored(spark.createDataFrame([("a.b", 1), ("", 2), ("c", 3), ("a.b", 4)], "pred string, n long"), "by-name", by="pred")
    assert table.columns == ["pred", "n"] and sorted(map(tuple, table.collect())) == [("", 2), ("a.b", 1), ("a.b", 4), ("c", 3)]
    chosen = table.where(F.col("pred").isin("c"))
    assert [tuple(r) for r in chosen.collect()] == [("c", 3)]
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(coalesce(pred" in plan


def test_a_pick_is_one_join_with_a_stored_table(ring, monkeypatch):
    """Equal picks share their table of references and targets."""
    names = []
    real = browse.stored
    monkeypatch.setattr(browse, "stored", lambda df, name: names.append(name) or real(df, name))
    row = browse.sessions(ring, F.col("id") == "_1", [1, 1, "b", 2]).first()
    assert row["start"] == "_1" and names.count("browse-step") == 2


def test_one_id_and_one_class_need_no_stored_versions(spark):
    import os

    from gridweft.operators.diff import diff_single
    from gridweft.sources import sinks, star

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables")
    first = star.star_grid(spark, "/root/testdata/sf0.001")
    second = star.edited(first)
    assert diff_single(first, second, "_SS7").first()["id"] == "_SS7"
    rows = sinks.objects_text(first, "Substation").orderBy("nth").collect()
    assert [r["nth"] for r in rows] == list(range(1, len(rows) + 1)) and rows[0]["line"].startswith("[1] _SS")
    for grid in (first, second):
        assert not {"triples", "by_id", "positioned"} & set(grid.__dict__)


def test_views_of_the_star_model_are_those_of_its_triples(spark):
    import os

    from gridweft.operators.access import Grid
    from gridweft.sources import star

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables")
    grid = star.star_grid(spark, "/root/testdata/sf0.001")
    asked = (["Substation", "SynchronousMachine", "PowerTransformerEnd"], {"name": "IdentifiedObject.name", "g": "PowerTransformerEnd.g"}, {"unit": "RotatingMachine.GeneratingUnit", "none": "No.such", "as_ref": "IdentifiedObject.name"})
    direct = grid.view(*asked)
    assert "Aggregate" not in direct._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: sorted(map(repr, df.select("model", "id", "doc_pos", "type", "name", "g", "unit", "none", "as_ref").collect()))
    assert rows(direct) == rows(Grid(grid.objects, grid.triples).view(*asked))
