import json

import pytest
from models import RDF, conversion_model, grid_of, node, terminal, thing

from gridweft.plans.convert import Conversion
from gridweft.sources.ordered_text import join_parts, part_files
from gridweft.sources.sinks import NetworkJson


@pytest.fixture(scope="module")
def written(spark):
    return NetworkJson(Conversion(grid_of(spark, conversion_model())))


@pytest.fixture(scope="module")
def network(written):
    rows = written.documents().collect()
    assert len(rows) == 1
    return json.loads(rows[0]["json"])


def test_part_files_are_the_document(spark, written, tmp_path):
    """Written by many tasks and joined, byte by byte; models without members of a list, and with none at all."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        written.write(f"{tmp_path}/out")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(part_files(spark, f"{tmp_path}/out/model=m0")) > 1
    join_parts(spark, f"{tmp_path}/out/model=m0", f"{tmp_path}/whole.json", "\n")
    assert (tmp_path / "whole.json").read_text() == written.documents().first()["json"] + "\n"
    head = thing("FullModel", "FM1", {"Model.scenarioTime": "2026-01-01T09:00:00Z", "Model.created": "2026-01-01T01:00:00Z"}, about=True)
    area = thing("ControlArea", "CA", {}, {})
    bare, areas = (json.loads(r["json"]) for r in NetworkJson(Conversion(grid_of(spark, RDF.format(head), RDF.format(head + area)))).documents().orderBy("model").collect())
    assert bare["substations"] == bare["lines"] == [] and "areas" not in bare and list(bare)[-3:] == ["substations", "lines", "extensions"]
    assert [a["id"] for a in areas["areas"]] == ["CA"] and list(areas)[-4:] == ["substations", "lines", "areas", "extensions"]


def level(network, name):
    return next(v for s in network["substations"] for v in s["voltageLevels"] if v["id"] == name)


def test_header(network):
    assert network["id"] == "_FM1"
    assert network["caseDate"] == "2026-01-01T09:00:00.000Z"
    assert network["forecastDistance"] == 480
    assert list(network)[:3] == ["version", "extensionVersions", "id"]


def test_substations(network):
    assert [s["id"] for s in network["substations"]] == ["SS1", "SS2"]
    assert network["substations"][0]["country"] == "TestRegion"
    assert network["substations"][0]["geographicalTags"] == ["Sub"]
    assert level(network, "VL1")["nominalV"] == 220.0


def test_nodes(network):
    one = level(network, "VL1")
    assert one["nodeBreakerTopology"]["busbarSections"][0]["node"] == 0
    assert one["nodeBreakerTopology"]["internalConnections"] == [{"node1": 0, "node2": 8}, {"node1": 1, "node2": 9}]
    assert one["shunts"][0]["node"] == 2 and one["staticVarCompensators"][0]["node"] == 3
    assert [(g["id"], g["node"]) for g in one["generators"]] == [("GEN_TH", 4), ("GEN_HY", 5), ("GEN_CO", 6), ("GEN_CU", 7)]
    assert one["loads"][0]["node"] == 9 and one["loads"][0]["name"] == 'L"1'


def test_lines(network):
    line = next(x for x in network["lines"] if x["id"] == "LINE1")
    assert (line["g1"], line["b1"], line["g2"], line["b2"]) == (2.0, 3.0, 2.0, 3.0)
    assert line["node1"] == 1 and line["node2"] == 0
    assert [a["type"] for a in line["aliases"]] == ["CGMES.Terminal1", "CGMES.Terminal2"]
    assert line["properties"] == [{"name": "CGMES.originalClass", "value": "ACLineSegment"}]
    other = next(x for x in network["lines"] if x["id"] == "LINE_BNDRY")
    assert (other["voltageLevelId1"], other["node1"], other["voltageLevelId2"], other["node2"]) == ("VL1", 8, "CN_BNDRY_VL", 1)
    assert len(network["lines"]) == 2


def test_fictitious(network):
    (one,) = network["voltageLevels"]
    assert one["id"] == "CN_BNDRY_VL" and one["name"] is None and "nominalV" not in one
    assert one["nodeBreakerTopology"]["internalConnections"] == [{"node1": 0, "node2": 1}]
    assert one["properties"] == [{"name": "CGMES.LineContainerId", "value": "LINE_CTR"}]


def test_generators(network):
    by = {g["id"]: g for g in level(network, "VL1")["generators"]}
    assert by["GEN_TH"]["energySource"] == "THERMAL" and by["GEN_HY"]["energySource"] == "HYDRO"
    assert (by["GEN_TH"]["minP"], by["GEN_TH"]["maxP"]) == (50.0, 500.0)
    assert by["GEN_CO"]["isCondenser"] is True and "isCondenser" not in by["GEN_TH"]
    assert by["GEN_CU"]["reactiveCapabilityCurve"]["points"] == [{"p": 100.0, "minQ": -150.0, "maxQ": 250.0}]
    assert "minMaxReactiveLimits" not in by["GEN_CU"] and by["GEN_TH"]["minMaxReactiveLimits"] == {"minQ": -200.0, "maxQ": 200.0}
    assert {"name": "CGMES.fuelType", "value": "coal"} in by["GEN_TH"]["properties"]


def test_extensions(network):
    extensions = network["extensions"]
    assert next(e for e in extensions if e["id"] == "LOAD1")["detail"]["fixedActivePower"] == 0.0
    assert next(e for e in extensions if e["id"] == "GEN_CO")["coordinatedReactiveControl"]["qPercent"] == 50.0
    last = extensions[-1]
    assert [m["id"] for m in last["cgmesMetadataModels"]["models"]] == ["_FM_EQBD", "_FM1"]
    assert last["cgmesMetadataModels"]["models"][1]["description"] == "a b <c>"
    assert last["cgmesMetadataModels"]["models"][1]["subset"] == "EQUIPMENT"
    assert last["baseVoltageMapping"]["baseVoltages"] == [{"nominalVoltage": 220.0, "source": "BOUNDARY", "id": "BV220"}]
    assert [v["extensionName"] for v in network["extensionVersions"]] == ["detail", "coordinatedReactiveControl", "cgmesMetadataModels", "baseVoltageMapping", "cimCharacteristics"]


def test_areas(network):
    assert network["areas"] == [{"id": "CA1", "name": "TestArea", "areaType": "ControlAreaTypeKind.Interchange", "areaBoundaries": [{"ac": True, "type": "terminalRef", "id": "LINE1", "side": "ONE"}]}]


def _levels(*names, substation="S"):
    return [thing("VoltageLevel", n, {"IdentifiedObject.mRID": m}, {"VoltageLevel.Substation": s}) for n, m, s in names]


def test_merges(spark):
    """Switches, open or closed, merge levels; a transformer merges substations."""
    parts = [
        *[thing("Substation", s) for s in ("S1", "S2", "S3")],
        *_levels(("a", "3", "S1"), ("b", "1", "S1"), ("c", "2", "S2"), ("d", "4", "S3")),
        *[node(f"n{x}", x) for x in "abcd"],
        thing("Breaker", "sw1", {"Switch.open": "true"}),
        terminal("sw1a", "sw1", "na", 1),
        terminal("sw1b", "sw1", "nb", 2),
        thing("Disconnector", "sw2"),
        terminal("sw2a", "sw2", "nb", 1),
        terminal("sw2b", "sw2", "nc", 2),
        thing("PowerTransformer", "t"),
        terminal("ta", "t", "na", 1),
        terminal("tb", "t", "nd", 2),
        *[
            thing("PowerTransformerEnd", f"e{k}", {f"PowerTransformerEnd.{n}": v for n, v in p.items()} | {"TransformerEnd.endNumber": k}, {"PowerTransformerEnd.PowerTransformer": "t", "TransformerEnd.Terminal": e})
            for k, e, p in ((1, "ta", {"ratedU": 400, "r": 16, "x": 32, "g": 1e-4, "b": 2e-4}), (2, "tb", {"ratedU": 100}))
        ],
        thing("RatioTapChanger", "tc", {"TapChanger.lowStep": -1, "TapChanger.highStep": 1, "TapChanger.neutralStep": 0, "TapChanger.normalStep": 0, "TapChanger.ltcFlag": "true", "RatioTapChanger.stepVoltageIncrement": "1.25"}, {"RatioTapChanger.TransformerEnd": "e2"}),
    ]
    conversion = Conversion(grid_of(spark, RDF.format("".join(parts))))
    assert {(r["id"], r["representative"]) for r in conversion.index.vl_merge.collect()} == {("_a", "_b"), ("_b", "_b"), ("_c", "_b")}
    assert {r["representative"] for r in conversion.index.substation_merge.collect()} == {"_S1"}
    (document,) = NetworkJson(conversion).documents().collect()
    network = json.loads(document["json"])
    (site,) = network["substations"]
    assert [a["content"] for a in site["aliases"]] == ["S2", "S3"]
    merged = next(v for v in site["voltageLevels"] if v["id"] == "1")
    assert merged["aliases"] == [{"type": "MergedVoltageLevel1", "content": "3"}, {"type": "MergedVoltageLevel2", "content": "2"}]
    assert [(s["kind"], s["open"]) for s in merged["nodeBreakerTopology"]["switches"]] == [("BREAKER", True), ("DISCONNECTOR", False)]
    (transformer,) = site["twoWindingsTransformers"]
    assert [transformer[k] for k in ("r", "x")] == [1.0, 2.0] and transformer["g"] == pytest.approx(1.6e-3)
    assert [s["rho"] for s in transformer["ratioTapChanger"]["steps"]] == [0.9875, 1.0, 1.0125]


def test_node_rules(spark):
    """Three others on a node: all dedicated; two: the first keeps the node; a bay stands for its level."""
    parts = [
        thing("Substation", "S"), *_levels(("v", "v", "S")), thing("Bay", "bay", {}, {"Bay.VoltageLevel": "v"}),
        node("n1", "bay"), node("n2", "v"),
        *[x for i in range(3) for x in (thing("EnergyConsumer", f"l{i}"), terminal(f"l{i}t", f"l{i}", "n1"))],
        thing("EnergyConsumer", "k"), terminal("kt", "k", "n2"), thing("SynchronousMachine", "g"), terminal("gt", "g", "n2"),
        thing("OperationalLimitSet", "set", {}, {"OperationalLimitSet.Terminal": "kt"}),
    ]
    index = Conversion(grid_of(spark, RDF.format("".join(parts)))).index
    nodes = {r["terminal"]: (r["node"], r["dedicated"]) for r in index.node_map.collect()}
    assert nodes == {"_gt": (1, False), "_l0t": (2, True), "_l1t": (3, True), "_l2t": (4, True), "_kt": (5, True)}
    assert [(r["node1"], r["node2"]) for r in index.internal_connections.orderBy("nth").collect()] == [(0, 2), (0, 3), (0, 4), (1, 5)]


def test_limits(spark):
    parts = [
        thing("Substation", "S"), *_levels(("v", "v", "S")), node("n1", "v"), node("n2", "v"),
        thing("ACLineSegment", "l"), terminal("t1", "l", "n1", 1), terminal("t2", "l", "n2", 2),
        thing("OperationalLimitType", "inf", {"OperationalLimitType.isInfiniteDuration": "true"}, {"OperationalLimitType.direction": "http://c#D.high"}),
        thing("OperationalLimitType", "fin", {"OperationalLimitType.isInfiniteDuration": "false"}, {"OperationalLimitType.direction": "http://c#D.low"}),
        thing("OperationalLimitSet", "set", {}, {"OperationalLimitSet.Terminal": "t1"}),
        *[thing("CurrentLimit", f"c{i}", {"CurrentLimit.value": v}, {"OperationalLimit.OperationalLimitSet": "set", "OperationalLimit.OperationalLimitType": k}) for i, (v, k) in enumerate(((100, "inf"), (" 1e3 ", "inf"), (9, "fin")))],
        *[thing("VoltageLimit", f"v{i}", {"VoltageLimit.normalValue": v}, {"OperationalLimit.OperationalLimitSet": "set", "OperationalLimit.OperationalLimitType": k}) for i, (v, k) in enumerate(((420, "inf"), (380, "fin")))],
    ]
    (document,) = NetworkJson(Conversion(grid_of(spark, RDF.format("".join(parts))))).documents().collect()
    network = json.loads(document["json"])
    (line,) = network["lines"]
    (group,) = line["operationalLimitsGroups1"]
    assert group["currentLimits"]["permanentLimit"] == 1000.0 and line["selectedOperationalLimitsGroupId1"] == "set"
    assert group["properties"][0] == {"name": "CGMES.normalValue_CurrentLimit_patl", "value": "1000.0"}
    assert level(network, "v")["highVoltageLimit"] == 420.0 and level(network, "v")["lowVoltageLimit"] == 380.0
