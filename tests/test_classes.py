"""Tables of the index by class, numbers that are ranked once, extensions by kind, steps that shuffle what they reach."""

import os

import pytest
from models import RDF, conversion_model, grid_of, node, terminal, thing
from pyspark.sql import functions as F

from gridweft.operators import access
from gridweft.plans.convert import Conversion
from gridweft.plans.index import LINES, LOADS, NUMBERED, Index
from gridweft.sources import sinks, star

FOLDER = "/root/testdata/sf0.001"


def pairs(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture
def tables(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables")
    return star.star_grid(spark, FOLDER)


def test_terminals_of_the_star_model_know_their_equipment(tables):
    """Without a look-up of all objects, and as the look-up finds it."""
    index = Index(tables)
    direct = index.terminal_rows
    plan = direct._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "by_id" not in tables.__dict__
    columns = ["id", "doc_pos", "equipment", "cn", "seq", "eq_type", "eq_pos"]
    assert pairs(direct, *columns) == pairs(Index(access.Grid(tables.objects, tables.triples)).terminal_rows, *columns)


def test_terminals_of_a_class_are_ranked_as_all_are(spark):
    parts = thing("Breaker", "S") + thing("ACLineSegment", "L") + terminal("S2", "S", None, 2) + terminal("S1", "S", None, 1) + terminal("L1", "L", None) + terminal("L2", "L", None) + terminal("X", "9", None)
    index = Index(grid_of(spark, RDF.format(parts)))
    columns = ["id", "equipment", "nth", "n"]
    every = pairs(index.terminals, *columns)
    assert ("_X", "_9", 1, 1) in every and ("_S2", "_S", 2, 2) in every
    assert pairs(index.terminals_of("Breaker"), *columns) == [r for r in every if r[1] == "_S"]


def test_a_missing_equipment_is_an_error_for_every_class(spark):
    parts = thing("BusbarSection", "B") + terminal("T", "B", None) + thing("Terminal", "U")
    grid = grid_of(spark, RDF.format(parts))
    with pytest.raises(Exception, match="Terminal.ConductingEquipment is missing: _U"):
        Index(grid, strict=True).terminals_of("BusbarSection").collect()
    assert pairs(Index(grid).terminals_of("BusbarSection"), "id") == [("_T",)]


def test_busbars_and_switches_need_no_ranks(spark, tables):
    """Their places are those of the whole numbering, which isn't made for them, nor are objects by id or merged substations."""
    model = RDF.format(thing("Substation", "S") + thing("VoltageLevel", "V", {}, {"VoltageLevel.Substation": "S"}) + node("N", "V") + node("M", "V") + thing("BusbarSection", "B") + terminal("BT", "B", "M") + thing("Breaker", "K") + terminal("K1", "K", "N") + terminal("K2", "K", "M") + node("O", "S") + thing("BusbarSection", "C") + terminal("CT", "C", "O"))
    for grid in (grid_of(spark, model), tables):
        conversion, whole = Conversion(grid), Conversion(grid)
        assert whole.index.numbered.count()
        for made in ("busbars", "switches"):
            found = getattr(conversion, made)()
            assert pairs(found, *found.columns) == pairs(getattr(whole, made)(), *found.columns)
        assert not {"numbered", "substation_merge"} & set(conversion.index.__dict__)
    assert "by_id" not in tables.__dict__


def test_sites_are_the_places_without_numbers(spark, tables):
    for grid in (grid_of(spark, conversion_model()), tables):
        index = Index(grid)
        assert index.sited(*LOADS).count() and pairs(index.sited(*NUMBERED), "model", "id") == pairs(index.equipment_places(*NUMBERED), "model", "id")


def test_places_of_lines_are_those_of_all_terminals(spark):
    conversion = Conversion(grid_of(spark, conversion_model()))
    every = pairs(conversion.line_places(), "terminal", "vl_mrid", "node")
    lines = pairs(conversion.line_places(*LINES), "terminal", "vl_mrid", "node")
    assert ("_LINE_BNDRY-T2", "CN_BNDRY_VL", 1) in lines and lines == [r for r in every if r[0].startswith("_LINE")]


def test_one_extension_is_made_alone(spark, tables):
    """The heads of documents are the same whether the extensions are stored or not."""
    bare = RDF.format(thing("FullModel", "F", {"Model.scenarioTime": "2026-01-01T09:00:00Z"}, {}, about=True))
    grids = (grid_of(spark, conversion_model(), bare, RDF.format(thing("BaseVoltage", "B", {"BaseVoltage.nominalVoltage": "1"}))), tables)
    for grid in grids:
        network = sinks.NetworkJson(Conversion(grid))
        last = pairs(network.extension(3), "model", "json")
        heads = pairs(network.heads(), "model", "head")
        assert not {"extensions", "elements"} & set(network.__dict__) and "numbered" not in network.c.index.__dict__
        details = pairs(network.extension(1), "doc_pos", "json")
        assert details == pairs(network.extensions.where("kind = 1"), "doc_pos", "json") and [d[0] for d in details] == [r[0] for r in pairs(network.c.loads(), "doc_pos")]
        assert heads == pairs(network.heads(), "model", "head") and last == pairs(network.extensions.where("kind = 3"), "model", "json")


def test_a_step_shuffles_what_it_reaches(spark, tables, monkeypatch):
    """With the bitmap as with whole keys; no stored triples, no objects by id."""
    from gridweft.operators import sieve

    parts = thing("A", "1", {}, {"x": "2"}) + thing("B", "2", {}, {"y": "3", "z": "4", "w": "9"}) + thing("C", "3", {}, {"x": "1"}) + thing("D", "4", {}, {"x": "5"}) + thing("A", "6") + thing("E", "6") + thing("E", "5")
    ring = grid_of(spark, RDF.format(parts))
    want = [("_1", 0), ("_2", 1), ("_3", 2), ("_4", 2)]
    for few in (sieve.FEW, 0):
        monkeypatch.setattr(sieve, "FEW", few)
        assert pairs(ring.neighbourhood(F.col("type") == "A", 2), "id", "distance") == want
        assert pairs(ring.neighbourhood(F.col("type") == "A", 9), "id", "distance") == [*want, ("_5", 3)]
        assert ring.neighbourhood(F.col("type") == "Z", 2).count() == 0
    found = tables.neighbourhood(F.col("type") == "VoltageLevel", 3)
    assert {r["distance"] for r in found.select("distance").distinct().collect()} == {0, 1, 2, 3}
    assert not {"triples", "by_id"} & set(tables.__dict__)
