"""The registered queries of the grid engine, each with DuckDB SQL over the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweft.functions import scalars as S
from gridweft.operators import browse
from gridweft.operators import diff as D
from gridweft.operators.snapshots import changed_parts, write_snapshot
from gridweft.plans.convert import Conversion
from gridweft.plans.index import NUMBERED, SWITCHES, Index
from gridweft.sources import rdfxml, sinks, splits
from gridweft.sources.star import CTES, CTES_V2, OBJECTS_V2, edited, narrow_ctes, star_grid, write_models
from gridweft.storage import new_path, stored

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, ctes: str | None = None):
    """Register a function (grid) -> DataFrame under its name, over the star model; ``ctes`` stands for all views of the oracles."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(star_grid(spark, sf_dir))
        if sql:
            # A text that begins with a comma opens with further common table expressions.
            ORACLE_SQL[f.__name__] = f"WITH RECURSIVE {CTES}, {_COMMON} {sql}" if ctes is None else f"WITH {ctes} {sql}"
        return f

    return add


def table_query(sql: str):
    """Register a function (spark, sf_dir) -> DataFrame under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


_first = lambda c, pred: f"arg_min({c}, pos) FILTER (WHERE pred = '{pred}' AND {c} IS NOT NULL)"
_switches, _numbered = ", ".join(f"'{x}'" for x in SWITCHES), ", ".join(f"'{x}'" for x in NUMBERED)

#: Columns of the oracles' view of objects: properties and references by name.
_TEXTS = {
    "mrid": "IdentifiedObject.mRID", "name": "IdentifiedObject.name", "seq": "ACDCTerminal.sequenceNumber", "open": "Switch.open", "retained": "Switch.retained", "sections": "ShuntCompensator.sections", "most": "ShuntCompensator.maximumSections",
    "bsec": "LinearShuntCompensator.bPerSection", "line_r": "ACLineSegment.r", "line_x": "ACLineSegment.x", "bch": "ACLineSegment.bch", "gch": "ACLineSegment.gch", "series_r": "SeriesCompensator.r", "series_x": "SeriesCompensator.x",
    "minq": "SynchronousMachine.minQ", "maxq": "SynchronousMachine.maxQ", "rated_s": "RotatingMachine.ratedS", "q_percent": "SynchronousMachine.qPercent", "control": "RegulatingCondEq.controlEnabled", "bmin": "StaticVarCompensator.bMin", "bmax": "StaticVarCompensator.bMax",
    "minp": "GeneratingUnit.minOperatingP", "maxp": "GeneratingUnit.maxOperatingP", "infinite": "OperationalLimitType.isInfiniteDuration", "value": "CurrentLimit.value", "normal": "CurrentLimit.normalValue", "voltage": "VoltageLimit.normalValue", "nominal": "BaseVoltage.nominalVoltage",
    "end_number": "TransformerEnd.endNumber", "end_u": "PowerTransformerEnd.ratedU", "end_r": "PowerTransformerEnd.r", "end_x": "PowerTransformerEnd.x", "end_g": "PowerTransformerEnd.g", "end_b": "PowerTransformerEnd.b", "end_s": "PowerTransformerEnd.ratedS",
    "low_step": "TapChanger.lowStep", "high_step": "TapChanger.highStep", "neutral_step": "TapChanger.neutralStep", "normal_step": "TapChanger.normalStep", "ltc": "TapChanger.ltcFlag", "increment": "RatioTapChanger.stepVoltageIncrement",
    "point_r": "TapChangerTablePoint.r", "point_x": "TapChangerTablePoint.x", "point_ratio": "TapChangerTablePoint.ratio", "angle": "PhaseTapChangerTablePoint.angle", "xvalue": "CurveData.xvalue", "y1": "CurveData.y1value", "y2": "CurveData.y2value",
    "exponential": "LoadResponseCharacteristic.exponentModel", "np": "LoadResponseCharacteristic.pVoltageExponent", "c0p": "LoadResponseCharacteristic.pConstantPower",
    "scenario": "Model.scenarioTime", "created": "Model.created", "authority": "Model.modelingAuthoritySet", "description": "Model.description", "version": "Model.version",
}
_REFS = {
    "cn": "Terminal.ConnectivityNode", "eq": "Terminal.ConductingEquipment", "box": "ConnectivityNode.ConnectivityNodeContainer", "bay_vl": "Bay.VoltageLevel", "home": "VoltageLevel.Substation", "vl_base": "VoltageLevel.BaseVoltage", "eq_base": "ConductingEquipment.BaseVoltage",
    "region": "Substation.Region", "country": "SubGeographicalRegion.Region", "unit": "RotatingMachine.GeneratingUnit", "machine_kind": "SynchronousMachine.type", "curve": "SynchronousMachine.InitialReactiveCapabilityCurve", "control_ref": "RegulatingCondEq.RegulatingControl",
    "wind": "WindGeneratingUnit.windGenUnitType", "fuel_unit": "FossilFuel.ThermalGeneratingUnit", "fuel": "FossilFuel.fossilFuelType", "control_mode": "RegulatingControl.mode", "control_terminal": "RegulatingControl.Terminal", "svc_mode": "StaticVarCompensator.regulationMode",
    "response": "EnergyConsumer.LoadResponse", "set_terminal": "OperationalLimitSet.Terminal", "set_id": "OperationalLimit.OperationalLimitSet", "type_id": "OperationalLimit.OperationalLimitType", "direction": "OperationalLimitType.direction", "of_curve": "CurveData.Curve",
    "transformer": "PowerTransformerEnd.PowerTransformer", "end_terminal": "TransformerEnd.Terminal", "ratio_end": "RatioTapChanger.TransformerEnd", "ratio_table": "RatioTapChanger.RatioTapChangerTable", "phase_end": "PhaseTapChanger.TransformerEnd", "phase_table": "PhaseTapChanger.PhaseTapChangerTable",
    "of_ratio": "RatioTapChangerTablePoint.RatioTapChangerTable", "of_phase": "PhaseTapChangerTablePoint.PhaseTapChangerTable", "area_kind": "ControlArea.type", "area": "TieFlow.ControlArea", "flow_terminal": "TieFlow.Terminal",
}
_bare = lambda c: f"CASE WHEN starts_with({c}, '#') THEN substr({c}, 2) ELSE {c} END"
_columns = [f"{_first('text', p)} AS \"{a}\"" for a, p in _TEXTS.items()] + [f"{_bare(_first('ref', p))} AS \"{a}\"" for a, p in _REFS.items()]

#: Views that several oracles read. No object of the star model repeats a reference, so the first one is the only one.
_COMMON = f"""
attrs AS MATERIALIZED (
  SELECT subj_pos, {", ".join(_columns)} FROM tagrows GROUP BY subj_pos
), o AS MATERIALIZED (
  SELECT objects.*, attrs.*, coalesce(mrid, substr(id, 2)) AS mrid_or_id FROM objects LEFT JOIN attrs ON doc_pos = subj_pos
), terminals AS MATERIALIZED (
  SELECT t.id, t.doc_pos, t.eq AS equipment, t.cn, t.seq::INTEGER AS seq, e.type AS eq_type, e.doc_pos AS eq_pos,
         row_number() OVER (PARTITION BY t.eq ORDER BY t.seq::INTEGER, t.doc_pos) AS nth, count(*) OVER (PARTITION BY t.eq) AS n
  FROM o t LEFT JOIN o e ON e.id = t.eq WHERE t.type = 'Terminal'
), containers AS MATERIALIZED (
  SELECT n.id AS cn, n.doc_pos AS cn_pos, coalesce(b.bay_vl, n.box) AS container FROM o n LEFT JOIN o b ON b.id = n.box AND b.type = 'Bay' WHERE n.type = 'ConnectivityNode' AND n.box IS NOT NULL
), busbars AS MATERIALIZED (
  SELECT t.cn, arg_max(e.mrid_or_id, t.eq_pos) AS bbs FROM terminals t JOIN o e ON e.id = t.equipment WHERE t.eq_type = 'BusbarSection' AND t.n = 1 GROUP BY t.cn
), switch_ends AS MATERIALIZED (
  SELECT equipment AS id, max(cn) FILTER (WHERE nth = 1) AS cn1, max(cn) FILTER (WHERE nth = 2) AS cn2 FROM terminals WHERE eq_type IN ({_switches}) AND n = 2 GROUP BY equipment
), vl_edges AS (
  SELECT DISTINCT a.container AS a, b.container AS b FROM switch_ends s JOIN containers a ON a.cn = s.cn1 JOIN containers b ON b.cn = s.cn2 JOIN o x ON x.id = a.container AND x.type = 'VoltageLevel' JOIN o y ON y.id = b.container AND y.type = 'VoltageLevel' WHERE a.container <> b.container
), vl_both AS (SELECT a, b FROM vl_edges UNION SELECT b, a FROM vl_edges),
vl_reach AS (SELECT a AS n, a AS m FROM vl_both UNION SELECT e.b, r.m FROM vl_reach r JOIN vl_both e ON e.a = r.n),
vl_part AS MATERIALIZED (SELECT m AS id, min(n) AS part FROM vl_reach GROUP BY m),
vl_merge AS MATERIALIZED (
  SELECT p.id, first_value(p.id) OVER (PARTITION BY part ORDER BY q.mrid_or_id, p.id) AS representative FROM vl_part p JOIN o q ON q.id = p.id
), sited AS (
  SELECT t.equipment, t.nth, v.home FROM terminals t JOIN containers c ON c.cn = t.cn JOIN o v ON v.id = c.container AND v.type = 'VoltageLevel' WHERE t.eq_type = 'PowerTransformer'
), sub_edges AS MATERIALIZED (
  SELECT x.home AS a, y.home AS b FROM vl_merge m JOIN o x ON x.id = m.id JOIN o y ON y.id = m.representative WHERE x.home <> y.home
  UNION SELECT s.home, f.home FROM sited s JOIN (SELECT equipment, arg_min(home, nth) AS home FROM sited GROUP BY equipment) f ON f.equipment = s.equipment WHERE s.home <> f.home
), sub_both AS (SELECT a, b FROM sub_edges UNION SELECT b, a FROM sub_edges),
sub_reach AS (SELECT a AS n, a AS m FROM sub_both UNION SELECT e.b, r.m FROM sub_reach r JOIN sub_both e ON e.a = r.n),
sub_merge AS MATERIALIZED (SELECT m AS id, min(n) AS representative FROM sub_reach GROUP BY m),
lv AS MATERIALIZED (
  SELECT v.id AS vl, coalesce(m.representative, v.id) AS representative FROM o v LEFT JOIN vl_merge m ON m.id = v.id WHERE v.type = 'VoltageLevel'
), kept AS MATERIALIZED (
  SELECT v.id AS vl, v.doc_pos, v.mrid_or_id AS mrid, coalesce(s.representative, v.home) AS substation
  FROM lv JOIN o v ON v.id = lv.vl LEFT JOIN sub_merge s ON s.id = v.home WHERE lv.vl = lv.representative
), nodes AS MATERIALIZED (
  SELECT c.cn, c.cn_pos, lv.representative AS vl, row_number() OVER (PARTITION BY lv.representative ORDER BY c.cn_pos) - 1 AS base, count(*) OVER (PARTITION BY lv.representative) AS size
  FROM containers c JOIN lv ON lv.vl = c.container
), ranked AS MATERIALIZED (
  SELECT t.*, n.vl, n.base, n.size, t.eq_type IN ('BusbarSection', {_switches}) AS fixed, b.bbs IS NOT NULL AS has_bbs,
         count(*) FILTER (WHERE t.eq_type NOT IN ('BusbarSection', {_switches})) OVER (PARTITION BY t.cn) AS others, list_position([{_numbered}], t.eq_type) AS rank
  FROM terminals t JOIN nodes n ON n.cn = t.cn LEFT JOIN busbars b ON b.cn = t.cn
), flagged AS MATERIALIZED (
  SELECT *, NOT fixed AND (has_bbs OR others >= 3 OR row_number() OVER (PARTITION BY cn, fixed ORDER BY rank, eq_pos, seq, doc_pos) > 1) AS dedicated FROM ranked WHERE fixed OR rank IS NOT NULL
), node_map AS MATERIALIZED (
  SELECT id AS terminal, cn, vl, base,
         (CASE WHEN dedicated THEN size + row_number() OVER (PARTITION BY vl, dedicated ORDER BY rank, eq_pos, seq, doc_pos) - 1 ELSE base END)::INTEGER AS node, dedicated FROM flagged
), places AS MATERIALIZED (
  SELECT e.*, e.mrid_or_id AS eq_mrid, t.id AS t_id, nm.node, nm.vl AS place FROM o e JOIN terminals t ON t.equipment = e.id AND t.nth = 1 JOIN node_map nm ON nm.terminal = t.id
)
"""


# Inventory and access


@query("SELECT model, type, count(*) AS n FROM objects GROUP BY ALL")
def a_type_counts(grid):
    return grid.type_counts()


@query("SELECT model, type, count(*) AS n FROM objects GROUP BY ROLLUP(model, type) HAVING model IS NOT NULL")
def a_types_report(grid):
    return grid.types_report()


@query("SELECT model, doc_pos, id, type, coalesce(name, 'N/A') AS \"IdentifiedObject.name\" FROM o WHERE type = 'Substation'")
def get_list(grid):
    return grid.get_list("Substation", " IdentifiedObject.name ")


@query("SELECT model, count(*) AS n FROM objects WHERE type = 'VoltageLevel' GROUP BY model")
def get_count(grid):
    return grid.get_count("VoltageLevel")


@query("SELECT model, '_SS7' AS id, 'Substation' AS type, 'type_mismatch' AS status FROM objects WHERE id = '_SS7'")
def get_single(grid):
    return grid.get_single("_SS7", "VoltageLevel")


@query("SELECT model, doc_pos, id, type FROM objects WHERE type = 'ConnectivityNode'")
def objects_by_type(grid):
    return grid.of_type("ConnectivityNode").select("model", "doc_pos", "id", "type")


@query("SELECT model, id, doc_pos, type FROM objects")
def object_by_id(grid):
    return grid.by_id.select("model", "id", "doc_pos", "type")


@query("SELECT model, id, name FROM o WHERE type = 'Substation'")
def get_property(grid):
    return grid.view(["Substation"], {"name": "IdentifiedObject.name"}).select("model", "id", "name")


@query("SELECT model, id, region FROM o WHERE type = 'Substation'")
def get_reference(grid):
    return grid.view(["Substation"], {}, {"region": "Substation.Region"}).select("model", "id", "region")


@query("SELECT model, id, seq, cn, eq FROM o WHERE type = 'Terminal'")
def get_properties(grid):
    return grid.view(["Terminal"], {"seq": "ACDCTerminal.sequenceNumber"}, {"cn": "Terminal.ConnectivityNode", "eq": "Terminal.ConductingEquipment"}).select("model", "id", "seq", "cn", "eq")


@query("SELECT o.model, o.id AS subj, t.pred, arg_max(t.text, t.pos) AS value FROM tagrows t JOIN objects o ON o.doc_pos = t.subj_pos WHERE t.text IS NOT NULL GROUP BY ALL")
def all_properties(grid):
    return grid.all_properties().select("model", "subj", "pred", "value")


@query("SELECT o.model, o.id AS subj, t.pred, arg_max(t.ref, t.pos) AS value FROM tagrows t JOIN objects o ON o.doc_pos = t.subj_pos WHERE t.ref IS NOT NULL GROUP BY ALL")
def all_references(grid):
    return grid.all_references().select("model", "subj", "pred", "value")


@query(
    ", units AS (SELECT subj_pos, substr(ref, 2) AS unit FROM tagrows) SELECT s.model, s.id, r.unit, u.type AS unit_type FROM objects s LEFT JOIN units r ON r.subj_pos = s.doc_pos LEFT JOIN (SELECT id, type FROM objects WHERE type LIKE '%GeneratingUnit') u ON u.id = r.unit WHERE s.type = 'SynchronousMachine'",
    narrow_ctes({"RotatingMachine.GeneratingUnit"}),
)
def ref_deref(grid):
    rows = grid.view(["SynchronousMachine"], {}, {"unit": "RotatingMachine.GeneratingUnit"}).select("model", "id", "unit")
    return grid.deref(rows, "unit", "unit").select("model", "id", "unit", "unit_type")


@query("SELECT model, id, mrid_or_id AS mrid FROM o WHERE type = 'LinearShuntCompensator'")
def mrid_or_id(grid):
    return grid.named(["LinearShuntCompensator"]).select("model", "id", "mrid")


@query("SELECT o.model, o.id AS subj, (row_number() OVER (PARTITION BY t.subj_pos ORDER BY t.pos))::INTEGER AS n, t.pred, CASE WHEN starts_with(t.ref, '#') THEN substr(t.ref, 2) ELSE t.ref END AS target FROM tagrows t JOIN objects o ON o.doc_pos = t.subj_pos WHERE t.ref IS NOT NULL")
def j_browse_hop(grid):
    return grid.hops()


@query(
    """, walk AS (
      SELECT id, 0 AS distance FROM objects WHERE type = 'VoltageLevel'
      UNION SELECT e.id, w.distance + 1 FROM walk w JOIN objects s ON s.id = w.id JOIN tagrows t ON t.subj_pos = s.doc_pos JOIN objects e ON '#' || e.id = t.ref WHERE w.distance < 3
    ) SELECT 'star' AS model, id, min(distance)::INTEGER AS distance FROM walk GROUP BY id"""
)
def g_browse_path(grid):
    return grid.neighbourhood(F.col("type") == "VoltageLevel", 3)


_EDGES = """, refs AS (
      SELECT o.id AS parent, (row_number() OVER (PARTITION BY t.subj_pos ORDER BY t.pos))::INTEGER AS pick, CASE WHEN starts_with(t.ref, '#') THEN substr(t.ref, 2) ELSE t.ref END AS target FROM tagrows t JOIN objects o ON o.doc_pos = t.subj_pos WHERE t.ref IS NOT NULL
    ), edges AS MATERIALIZED (SELECT r.*, e.type FROM refs r LEFT JOIN objects e ON e.id = r.target)"""


@query(
    f"""{_EDGES}, l0 AS (SELECT id, 0 AS distance, NULL::VARCHAR AS parent, NULL::INTEGER AS pick, type AS crumb, '' AS picks FROM objects WHERE type = 'PowerTransformerEnd'), """
    + ", ".join(
        f"""n{d} AS (SELECT target, min(struct_pack(p := g.parent, k := g.pick)) AS f, any_value(g.type) AS type FROM edges g JOIN l{d - 1} b ON b.id = g.parent WHERE g.type IS NOT NULL AND target NOT IN ({' UNION ALL '.join(f'SELECT id FROM l{k}' for k in range(d))}) GROUP BY target),
        l{d} AS (SELECT target AS id, {d} AS distance, f.p AS parent, f.k AS pick, crumb || ' -> ' || n.type AS crumb, CASE WHEN picks = '' THEN '' ELSE picks || ',' END || f.k AS picks FROM n{d} n JOIN l{d - 1} b ON b.id = n.f.p)"""
        for d in (1, 2, 3, 4)
    )
    + " SELECT 'star' AS model, * FROM (" + " UNION ALL ".join(f"SELECT * FROM l{d}" for d in range(5)) + ") x"
)
def g_browse_crumbs(grid):
    return browse.paths(grid, F.col("type") == "PowerTransformerEnd", 4)


_pick = lambda n, s, new: f"""{new} AS (SELECT start, CASE WHEN e.target IS NOT NULL AND note IS DISTINCT FROM 'not found' THEN e.target ELSE s.id END AS id, CASE WHEN e.type IS NOT NULL AND note IS DISTINCT FROM 'not found' THEN list_append(trail, struct_pack(id := e.target, type := e.type)) ELSE trail END AS trail,
      CASE WHEN note = 'not found' THEN note WHEN NOT EXISTS (SELECT 1 FROM edges x WHERE x.parent = s.id) THEN 'no references' WHEN e.target IS NULL THEN 'no such reference' WHEN e.type IS NULL THEN 'not found' END AS note FROM {s} s LEFT JOIN edges e ON e.parent = s.id AND e.pick = {n})"""  # noqa: E731
_back = lambda s, new: f"""{new} AS (SELECT start, CASE WHEN note = 'not found' THEN id WHEN len(trail) > 1 THEN trail[-2].id ELSE id END AS id, CASE WHEN note IS DISTINCT FROM 'not found' AND len(trail) > 1 THEN trail[:-2] ELSE trail END AS trail, CASE WHEN note = 'not found' THEN note WHEN len(trail) = 1 THEN 'already at root' END AS note FROM {s})"""


@query(
    f"""{_EDGES}, s0 AS (SELECT id AS start, id, [struct_pack(id := id, type := type)] AS trail, NULL::VARCHAR AS note FROM objects WHERE type IN ('Terminal', 'RatioTapChanger', 'Substation')),
    {_pick(2, 's0', 's1')}, {_pick(2, 's1', 's2')}, {_back('s2', 's3')}, {_pick(1, 's3', 's4')}
    SELECT 'star' AS model, start, id, list_aggregate(list_transform(trail, lambda x: x.type), 'string_agg', ' -> ') AS crumb, len(trail)::INTEGER AS depth, note FROM s4"""
)
def g_browse_sessions(grid):
    return browse.sessions(grid, F.col("type").isin("Terminal", "RatioTapChanger", "Substation"), [2, 2, "b", 1])


# Differences


def _versions(first) -> tuple:
    return first, edited(first)


def _diff(sql: str, ctes: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*_versions(star_grid(spark, sf_dir)))
        fields = """fields1 AS (SELECT o.model, o.type, o.id, kind, pred, arg_max(value, pos) AS value FROM (SELECT subj_pos, pos, pred, 'property' AS kind, text AS value FROM tagrows UNION ALL SELECT subj_pos, pos, pred, 'reference', ref FROM tagrows) t JOIN objects o ON o.doc_pos = t.subj_pos WHERE value IS NOT NULL GROUP BY ALL)"""
        both = f"{fields}, {fields.replace('fields1', 'fields2').replace('tagrows', 'tagrows2').replace('objects', 'objects2')}"
        changed = """statuses AS (SELECT coalesce(a.model, b.model) AS model, coalesce(a.type, b.type) AS type, coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'both' END AS status FROM objects a FULL JOIN objects2 b ON a.type = b.type AND a.id = b.id),
        changes AS (SELECT coalesce(a.model, b.model) AS model, coalesce(a.type, b.type) AS type, coalesce(a.id, b.id) AS id, coalesce(a.kind, b.kind) AS kind, coalesce(a.pred, b.pred) AS pred, a.value AS old, b.value AS new
          FROM fields1 a FULL JOIN fields2 b ON a.type = b.type AND a.id = b.id AND a.kind = b.kind AND a.pred = b.pred WHERE a.value IS DISTINCT FROM b.value),
        inner_changes AS (SELECT c.* FROM changes c JOIN statuses s ON s.type = c.type AND s.id = c.id AND s.status = 'both')"""
        ORACLE_SQL[f.__name__] = f"WITH {CTES}, {CTES_V2}, {both}, {changed} {sql}" if ctes is None else f"WITH {ctes} {sql}"
        return f

    return add


@_diff("SELECT model, type, id, CASE WHEN min(v) = 2 THEN 'added' WHEN max(v) = 1 THEN 'removed' ELSE 'both' END AS status FROM (SELECT model, type, id, 1 AS v FROM objects UNION ALL SELECT model, type, id, 2 FROM objects2) x GROUP BY model, type, id", f"{narrow_ctes(kinds=['substation'])}, {OBJECTS_V2}")
def j_diff_objects(old, new):
    return D.diff_objects(old, new)


@_diff(
    # Objects keep their positions in the second version, so that fields meet by them; those that change class are in one version each.
    """SELECT b.model, b.type, b.id, c.kind, c.pred, c.old, c.new FROM (
      SELECT subj_pos, kind, pred, arg_max(value, pos) FILTER (WHERE v = 1) AS old, arg_max(value, pos) FILTER (WHERE v = 2) AS new FROM (
        SELECT 1 AS v, subj_pos, pos, pred, 'property' AS kind, text AS value FROM tagrows UNION ALL SELECT 1, subj_pos, pos, pred, 'reference', ref FROM tagrows
        UNION ALL SELECT 2, subj_pos, pos, pred, 'property', text FROM tagrows2 UNION ALL SELECT 2, subj_pos, pos, pred, 'reference', ref FROM tagrows2) x
      WHERE value IS NOT NULL GROUP BY subj_pos, kind, pred HAVING old IS DISTINCT FROM new) c
    JOIN objects a ON a.doc_pos = c.subj_pos JOIN objects2 b ON b.doc_pos = c.subj_pos AND b.type = a.type""",
    f"{CTES}, {CTES_V2}",
)
def j_diff_fields(old, new):
    return D.diff_fields(old, new)


@_diff("SELECT model, type, count(*) FILTER (WHERE status = 'added') AS added, count(*) FILTER (WHERE status = 'removed') AS removed, count(*) FILTER (WHERE status = 'changed') AS changed FROM (SELECT * FROM statuses WHERE status <> 'both' UNION ALL SELECT DISTINCT model, type, id, 'changed' FROM inner_changes) GROUP BY ALL")
def a_diff_summary(old, new):
    return D.diff_summary(old, new)


@_diff("SELECT model, type, type || '  +' || count(*) FILTER (WHERE status = 'added') || ' -' || count(*) FILTER (WHERE status = 'removed') || ' ~' || count(*) FILTER (WHERE status = 'changed') AS line FROM (SELECT * FROM statuses WHERE status <> 'both' UNION ALL SELECT DISTINCT model, type, id, 'changed' FROM inner_changes) GROUP BY model, type")
def sink_diff_summary(old, new):
    return D.diff_summary_text(old, new)


@_diff("SELECT model, '_SS7' AS id, type, CASE WHEN EXISTS (SELECT 1 FROM inner_changes WHERE id = '_SS7') THEN 'changed' ELSE 'same' END AS status FROM objects WHERE id = '_SS7'")
def j_diff_single(old, new):
    return D.diff_single(old, new, "_SS7")


@_diff("SELECT * FROM statuses WHERE status <> 'both' UNION ALL SELECT DISTINCT model, type, id, 'changed' FROM inner_changes")
def j_diff_snapshots(old, new):
    """Added, removed and changed objects from two stored snapshots, of which equal buckets are not read."""
    return D.diff_status(*changed_parts(*(write_snapshot(g, new_path(g.spark, "snapshot"), 32) for g in (old, new))))


_change = """'{"property":"' || pred || '","from":' || coalesce('"' || old || '"', 'null') || ',"to":' || coalesce('"' || new || '"', 'null') || '}'"""
_LISTED = f""", listed AS (
  SELECT model, type, id, string_agg({_change}, ',' ORDER BY kind, pred) AS json,
         string_agg(coalesce(chr(10) || '  - ' || pred || ': "' || old || '"', '') || coalesce(chr(10) || '  + ' || pred || ': "' || new || '"', ''), '' ORDER BY kind, pred) AS lines FROM inner_changes GROUP BY ALL
), changed AS (
  SELECT model, type, id, status, NULL AS json, '' AS lines FROM statuses WHERE status <> 'both' UNION ALL SELECT model, type, id, 'changed', json, lines FROM listed
)"""


@_diff(f"""{_LISTED} SELECT model, type, id, '{{"type":"' || type || '","mrid":"' || id || '","status":"' || status || '"' || coalesce(',"changes":[' || json || ']', '') || '}}' AS line FROM changed""")
def sink_diff_ndjson(old, new):
    return D.diff_ndjson(old, new)


_NAMES = """, names AS (SELECT 1 AS v, subj_pos, arg_min(text, pos) AS name FROM tagrows WHERE pred = 'IdentifiedObject.name' AND text IS NOT NULL GROUP BY ALL UNION ALL SELECT 2, subj_pos, arg_min(text, pos) FROM tagrows2 WHERE pred = 'IdentifiedObject.name' AND text IS NOT NULL GROUP BY ALL)"""


@_diff(
    f"""{_LISTED}{_NAMES}, named AS (SELECT c.*, coalesce(CASE WHEN status = 'removed' THEN n1.name ELSE coalesce(n2.name, n1.name) END, '') AS name FROM changed c LEFT JOIN objects a ON a.type = c.type AND a.id = c.id LEFT JOIN objects2 b ON b.type = c.type AND b.id = c.id
    LEFT JOIN names n1 ON n1.v = 1 AND n1.subj_pos = a.doc_pos LEFT JOIN names n2 ON n2.v = 2 AND n2.subj_pos = b.doc_pos)
    SELECT 'star' AS model, '' AS sort_type, '' AS sort_id, '--- old' || chr(10) || '+++ new' AS line UNION ALL SELECT DISTINCT model, type, '', '@@ ' || type || ' @@' FROM changed
    UNION ALL SELECT model, type, id, CASE status WHEN 'added' THEN '+' WHEN 'removed' THEN '-' ELSE '~' END || ' ' || id || '  "' || name || '"' || lines FROM named"""
)
def sink_diff_text(old, new):
    return D.diff_text(old, new)


# Renderings

_VALUES = """, vals AS (
  SELECT o.model, o.type, o.id, o.doc_pos, kind, pred, arg_max(value, pos) AS value FROM (SELECT subj_pos, pos, pred, 'p' AS kind, text AS value FROM tagrows UNION ALL SELECT subj_pos, pos, pred, 'r', ref FROM tagrows) t JOIN objects o ON o.doc_pos = t.subj_pos WHERE value IS NOT NULL GROUP BY ALL
)"""


@query(
    f""", vals AS (
      SELECT subj_pos, pred, arg_max(text, pos) FILTER (WHERE text IS NOT NULL) AS said, arg_max(ref, pos) FILTER (WHERE ref IS NOT NULL) AS target FROM tagrows GROUP BY subj_pos, pred
    ), fields AS (SELECT subj_pos, string_agg('"' || pred || '":"' || said || '"', ',' ORDER BY pred) AS p, string_agg('"' || pred || '":"' || {_bare('target')} || '"', ',' ORDER BY pred) AS r FROM vals GROUP BY subj_pos)
    SELECT o.model, o.id, '{{"id":"' || o.id || '","type":"' || o.type || '","properties":{{' || coalesce(p, '') || '}},"references":{{' || coalesce(r, '') || '}}}}' AS json FROM objects o LEFT JOIN fields f ON f.subj_pos = o.doc_pos WHERE o.type IN ('Substation', 'Bay', 'FullModel')""",
    narrow_ctes(kinds={"substation", "bay", "model"}),
)
def sink_json_object(grid):
    return sinks.object_json(grid, ["Substation", "Bay", "FullModel"])


@query(f"""{_VALUES} SELECT o.model, concat_ws(chr(10), o.type || ' ' || o.id, string_agg('  ' || pred || ': ' || value, chr(10) ORDER BY kind, pred)) AS line FROM objects o JOIN vals v ON v.doc_pos = o.doc_pos WHERE o.id = '_SS7' GROUP BY o.model, o.type, o.id""")
def sink_text_object(grid):
    return sinks.object_text(grid, "_SS7")


@query(
    f"""{_VALUES}, numbered AS (SELECT *, row_number() OVER (ORDER BY doc_pos) AS nth FROM objects WHERE type = 'Substation')
    SELECT o.model, nth::INTEGER AS nth, concat_ws(chr(10), '[' || nth || '] ' || o.id, o.type || ' ' || o.id, string_agg('  ' || pred || ': ' || value, chr(10) ORDER BY kind, pred)) AS line FROM numbered o LEFT JOIN vals v ON v.doc_pos = o.doc_pos GROUP BY o.model, nth, o.id, o.type"""
)
def sink_text_list(grid):
    return sinks.objects_text(grid, "Substation")


@query("""SELECT model, '[' || string_agg('{"id":"' || id || '","type":"' || type || '","IdentifiedObject.name":"' || coalesce(name, '') || '"}', ',' ORDER BY doc_pos) || ']' AS json FROM o WHERE type = 'VoltageLevel' GROUP BY model""")
def sink_json_list(grid):
    return sinks.list_json(grid, "VoltageLevel", "IdentifiedObject.name")


# Index


@query("SELECT 'star' AS model, id, equipment, cn, seq, eq_type, nth::INTEGER AS nth, n FROM terminals")
def a_equipment_terminals(grid):
    return Index(grid).terminals.select("model", "id", "equipment", "cn", "seq", "eq_type", "nth", "n")


@query("SELECT 'star' AS model, cn, cn_pos, container FROM containers")
def j_cn_container(grid):
    return Index(grid).containers


@query("SELECT 'star' AS model, cn, bbs FROM busbars")
def j_cn_busbar(grid):
    return Index(grid).busbars


@query("SELECT 'star' AS model, id, representative FROM vl_merge")
def g_vl_merge(grid):
    return Index(grid).vl_merge


@query("SELECT 'star' AS model, id, representative FROM sub_merge")
def g_substation_merge(grid):
    return Index(grid).substation_merge


@query("SELECT 'star' AS model, terminal, cn, vl, node, dedicated FROM node_map")
def c_node_map(grid):
    return Index(grid).node_map


@query("SELECT 'star' AS model, vl, (row_number() OVER (PARTITION BY vl ORDER BY node))::INTEGER AS nth, base::INTEGER AS node1, node AS node2 FROM node_map WHERE dedicated")
def w_dedicated_node(grid):
    return Index(grid).internal_connections


@query(
    """, said AS (
      SELECT subj_pos, max(text) FILTER (WHERE pred = 'IdentifiedObject.name') AS name, max(text) FILTER (WHERE pred = 'CurrentLimit.value') AS value, max(text) FILTER (WHERE pred = 'CurrentLimit.normalValue') AS normal, max(text) FILTER (WHERE pred = 'OperationalLimitType.isInfiniteDuration') AS infinite,
             max(substr(ref, 2)) FILTER (WHERE pred = 'OperationalLimitSet.Terminal') AS terminal, max(substr(ref, 2)) FILTER (WHERE pred = 'OperationalLimit.OperationalLimitSet') AS set_id, max(substr(ref, 2)) FILTER (WHERE pred = 'OperationalLimit.OperationalLimitType') AS type_id FROM tagrows GROUP BY subj_pos
    ), kinds AS (SELECT o.id FROM objects o JOIN said ON subj_pos = doc_pos WHERE type = 'OperationalLimitType' AND infinite = 'true'),
    last AS (SELECT set_id, arg_max(struct_pack(v := trim(coalesce(value, normal)), m := substr(o.id, 2)), doc_pos) AS p FROM objects o JOIN said ON subj_pos = doc_pos JOIN kinds k ON k.id = type_id WHERE type = 'CurrentLimit' GROUP BY set_id)
    SELECT 'star' AS model, terminal, o.doc_pos AS set_pos, substr(o.id, 2) AS id, coalesce(name, substr(o.id, 2)) AS name, p.v AS patl_text, p.v::DOUBLE AS patl, p.m AS patl_mrid FROM objects o JOIN said ON subj_pos = doc_pos LEFT JOIN last ON last.set_id = o.id WHERE o.type = 'OperationalLimitSet'""",
    narrow_ctes(kinds={"limit type", "limit set", "current limit"}),
)
def a_limit_groups(grid):
    return Index(grid).limit_groups


# Conversion

#: Further views: limits of levels, ends of transformers, boundary nodes, busbar sections that switches reach.
_MORE = """
, stub_names AS (
  SELECT label, representative AS id, string_agg(label || nth || '=' || mrid, ',' ORDER BY doc_pos) AS aliases FROM (
    SELECT label, m.representative, v.doc_pos, v.mrid_or_id AS mrid, row_number() OVER (PARTITION BY label, m.representative ORDER BY v.doc_pos) AS nth
    FROM (SELECT 'MergedVoltageLevel' AS label, * FROM vl_merge UNION ALL SELECT 'MergedSubstation', * FROM sub_merge) m JOIN o v ON v.id = m.id WHERE m.id <> m.representative) GROUP BY ALL
), vlimits AS (
  SELECT c.container AS vl, arg_max(l.voltage::DOUBLE, l.doc_pos) FILTER (WHERE NOT ends_with(t.direction, 'high')) AS low, arg_max(l.voltage::DOUBLE, l.doc_pos) FILTER (WHERE ends_with(t.direction, 'high')) AS high
  FROM o l JOIN o t ON t.id = l.type_id AND t.direction IS NOT NULL JOIN o s ON s.id = l.set_id JOIN terminals m ON m.id = s.set_terminal JOIN containers c ON c.cn = m.cn JOIN o v ON v.id = c.container AND v.type = 'VoltageLevel'
  WHERE l.type = 'VoltageLimit' AND l.voltage IS NOT NULL GROUP BY c.container
), outside AS (
  SELECT t.*, c.cn_pos, c.container, row_number() OVER (PARTITION BY t.cn ORDER BY t.eq_type = 'SeriesCompensator', eq_pos, seq, t.doc_pos)::INTEGER AS node
  FROM terminals t JOIN containers c ON c.cn = t.cn WHERE t.eq_type IN ('ACLineSegment', 'SeriesCompensator') AND c.container NOT IN (SELECT vl FROM lv)
), fict AS (
  SELECT f.cn, f.cn_pos, n.mrid_or_id || '_VL' AS id, b.name, v.nominal::DOUBLE AS nominal_v, coalesce(b.mrid, substr(f.container, 2)) AS container, f.terminals
  FROM (SELECT cn, cn_pos, container, arg_min(equipment, node) AS segment, max(node) AS terminals FROM outside GROUP BY ALL) f
  JOIN o n ON n.id = f.cn LEFT JOIN o b ON b.id = f.container LEFT JOIN o s ON s.id = f.segment LEFT JOIN o v ON v.id = s.eq_base
), line_ends AS (
  SELECT nm.terminal, k.mrid AS vl, nm.node FROM node_map nm JOIN kept k ON k.vl = nm.vl
  UNION ALL SELECT t.id, f.id, t.node FROM outside t JOIN fict f ON f.cn = t.cn
), patls AS (
  SELECT l.set_id, arg_max(struct_pack(v := trim(coalesce(l.value, l.normal)), m := l.mrid_or_id), l.doc_pos) AS p FROM o l JOIN o t ON t.id = l.type_id WHERE l.type = 'CurrentLimit' AND t.infinite = 'true' GROUP BY l.set_id
), groups AS (
  SELECT s.set_terminal AS terminal, string_agg(s.mrid_or_id || '{' || concat_ws(';', 'CGMES.normalValue_CurrentLimit_patl=' || CASE WHEN contains(p.v, '.') THEN p.v ELSE p.v || '.0' END, 'CGMES.OperationalLimitSetName=' || coalesce(s.name, s.mrid_or_id),
         'CGMES.OperationalLimitSetRdfID=' || s.mrid_or_id, 'CGMES.OperationalLimit_CurrentLimit_patl=' || p.m) || '}' || coalesce(p.v::DOUBLE::VARCHAR, ''), ',' ORDER BY s.doc_pos) AS groups
  FROM o s LEFT JOIN patls ON patls.set_id = s.id WHERE s.type = 'OperationalLimitSet' GROUP BY s.set_terminal
), te AS (
  SELECT e.id, transformer, end_terminal, row_number() OVER (PARTITION BY transformer ORDER BY coalesce(end_number::INTEGER, 0), doc_pos) AS nth, count(*) OVER (PARTITION BY transformer) AS n,
         end_u::DOUBLE AS u, coalesce(end_r::DOUBLE, 0) AS r, coalesce(end_x::DOUBLE, 0) AS x, coalesce(end_g::DOUBLE, 0) AS g, coalesce(end_b::DOUBLE, 0) AS b, end_s::DOUBLE AS s
  FROM o e WHERE e.type = 'PowerTransformerEnd' AND transformer IS NOT NULL
), tp AS (
  SELECT te.*, k.vl, k.mrid AS vl_mrid, k.substation, nm.node, u IS NOT NULL AND nm.node IS NOT NULL AS usable FROM te LEFT JOIN node_map nm ON nm.terminal = te.end_terminal LEFT JOIN kept k ON k.vl = nm.vl
), points AS (
  SELECT of_phase IS NOT NULL AS phase, coalesce(of_phase, of_ratio) AS tab, (row_number() OVER (PARTITION BY type, coalesce(of_phase, of_ratio) ORDER BY doc_pos))::INTEGER AS nth,
         coalesce(point_r::DOUBLE, 0) AS r, coalesce(point_x::DOUBLE, 0) AS x, 1 / point_ratio::DOUBLE AS rho, CASE WHEN of_phase IS NOT NULL THEN coalesce(angle::DOUBLE, 0) END AS alpha
  FROM o WHERE coalesce(of_phase, of_ratio) IS NOT NULL AND point_ratio IS NOT NULL
), taps AS (
  SELECT type LIKE 'Phase%' AS phase, coalesce(ratio_end, phase_end) AS tap_end, coalesce(ratio_table, phase_table) AS tab, low_step::INTEGER AS low, high_step::INTEGER AS high, neutral_step::INTEGER AS neutral, normal_step::INTEGER AS position, ltc = 'true' AS ltc, increment::DOUBLE AS increment
  FROM o WHERE type IN ('RatioTapChanger', 'PhaseTapChangerTabular') AND normal_step IS NOT NULL
), steps AS MATERIALIZED (
  SELECT t.phase, tap_end, low, position, ltc, p.nth, p.r, p.x, p.rho, p.alpha FROM taps t JOIN points p ON p.phase = t.phase AND p.tab = t.tab
  UNION ALL SELECT phase, tap_end, low, position, ltc, (i - low + 1)::INTEGER, 0, 0, 1 + (i - neutral) * increment / 100, NULL FROM (SELECT *, unnest(range(low, high + 1)) AS i FROM taps WHERE NOT phase AND tab IS NULL AND increment IS NOT NULL)
), changers AS (
  SELECT phase, tap_end, position, count(*)::INTEGER AS n FROM steps GROUP BY ALL
)
"""
_REACH = """
, cn_edges AS (SELECT DISTINCT cn1 AS a, cn2 AS b FROM switch_ends WHERE cn1 <> cn2 UNION SELECT DISTINCT cn2, cn1 FROM switch_ends WHERE cn1 <> cn2),
cn_reach AS (SELECT a AS n, a AS m FROM cn_edges UNION SELECT e.b, r.m FROM cn_reach r JOIN cn_edges e ON e.a = r.n),
cn_part AS (SELECT c.cn, c.cn_pos, coalesce(p.part, c.cn) AS part FROM containers c LEFT JOIN (SELECT m, min(n) AS part FROM cn_reach GROUP BY m) p ON p.m = c.cn),
reach AS (SELECT p.cn, h.bbs FROM cn_part p JOIN (SELECT part, arg_min(bbs, cn_pos) AS bbs FROM cn_part JOIN busbars USING (cn) GROUP BY part) h ON h.part = p.part)
"""


def _named(c: str, inner: str = "=", outer: str = ";", name: str = "name", value: str = "value"):
    """An array of structs as text."""
    return F.array_join(F.transform(c, lambda x: F.concat(x[name], F.lit(inner), x[value])), outer)


def _aliases(rows: DataFrame) -> DataFrame:
    return rows.withColumn("aliases", F.nullif(_named("aliases", outer=",", name="type", value="content"), F.lit("")))


@query(f"{_REACH} SELECT 'star' AS model, cn, bbs FROM reach")
def g_cn_busbar_reach(grid):
    return Index(grid).reachable_busbar


@query("SELECT 'star' AS model, id, scenario AS case_date, greatest(0, floor((epoch(scenario::TIMESTAMP) - epoch(created::TIMESTAMP)) / 60))::BIGINT AS forecast_distance FROM o WHERE type = 'FullModel' ORDER BY doc_pos LIMIT 1")
def c_network(grid):
    return Conversion(grid).network()


@query(f"{_MORE} SELECT s.model, s.id, s.doc_pos, s.mrid_or_id AS mrid, s.name, c.name AS country, r.name AS geo_tag, n.aliases FROM o s LEFT JOIN o r ON r.id = s.region LEFT JOIN o c ON c.id = r.country LEFT JOIN sub_merge m ON m.id = s.id LEFT JOIN stub_names n ON n.id = s.id WHERE s.type = 'Substation' AND (m.id IS NULL OR m.representative = s.id)")
def c_substations(grid):
    return _aliases(Conversion(grid).substations())


@query(f"{_MORE} SELECT 'star' AS model, k.vl AS id, k.doc_pos, k.mrid, v.name, k.substation, b.nominal::DOUBLE AS nominal_v, low, high, aliases FROM kept k JOIN o v ON v.id = k.vl LEFT JOIN o b ON b.id = v.vl_base LEFT JOIN vlimits l ON l.vl = k.vl LEFT JOIN stub_names n ON n.id = k.vl")
def c_voltage_levels(grid):
    return _aliases(Conversion(grid).voltage_levels())


@query(f"{_MORE} SELECT 'star' AS model, vl, low, high FROM vlimits")
def a_voltage_limits(grid):
    return Index(grid).voltage_limits


@query("SELECT model, place AS vl, doc_pos, mrid_or_id AS mrid, name, node FROM places WHERE type = 'BusbarSection'")
def c_busbars(grid):
    return Conversion(grid).busbars()


@query(
    f"SELECT p.model, p.place AS vl, (list_position([{_switches}], p.type) - 1)::INTEGER AS class_rank, p.doc_pos, p.eq_mrid AS mrid, p.name, CASE p.type WHEN 'Breaker' THEN 'BREAKER' WHEN 'Disconnector' THEN 'DISCONNECTOR' ELSE 'LOAD_BREAK_SWITCH' END AS kind, coalesce(p.retained = 'true', false) AS retained, p.open = 'true' AS open, p.node AS node1, n2.node AS node2 FROM places p JOIN terminals t2 ON t2.equipment = p.id AND t2.nth = 2 JOIN node_map n2 ON n2.terminal = t2.id WHERE p.type IN ({_switches})"
)
def c_switches(grid):
    return Conversion(grid).switches()


@query(
    """SELECT p.model, place AS vl, (list_position(['EnergyConsumer', 'ConformLoad', 'NonConformLoad'], p.type) - 1)::INTEGER AS class_rank, p.doc_pos, p.mrid_or_id AS mrid, p.name, node, p.type AS original_class, substr(t_id, 2) AS terminal1,
    CASE WHEN r.exponential = 'true' THEN r.np::DOUBLE END AS np, CASE WHEN r.exponential = 'true' THEN 0.0::DOUBLE END AS nq, CASE WHEN r.exponential = 'false' THEN r.c0p::DOUBLE END AS c0p, CASE WHEN r.exponential = 'false' THEN 0.0::DOUBLE END AS c1q
    FROM places p LEFT JOIN o r ON r.id = p.response WHERE p.type IN ('EnergyConsumer', 'ConformLoad', 'NonConformLoad')"""
)
def c_loads(grid):
    return Conversion(grid).loads().select("*", "exponential_model.np", "exponential_model.nq", "zip_model.c0p", "zip_model.c1q").drop("exponential_model", "zip_model")


@query(
    "SELECT model, place AS vl, doc_pos, mrid_or_id AS mrid, name, node, sections::BIGINT AS sections, coalesce(most::BIGINT, 0) AS max_sections, bsec::DOUBLE AS b, 0.0::DOUBLE AS g, coalesce(control = 'true', false) AS regulating FROM places WHERE type = 'LinearShuntCompensator'"
)
def c_shunts(grid):
    return Conversion(grid).shunts()


@query(
    "SELECT model, place AS vl, doc_pos, mrid_or_id AS mrid, name, node, bmin::DOUBLE AS b_min, coalesce(bmax::DOUBLE, 0) AS b_max, CASE WHEN ends_with(svc_mode, 'voltage') THEN 'VOLTAGE' WHEN ends_with(svc_mode, 'reactivePower') THEN 'REACTIVE_POWER' ELSE 'OFF' END AS mode, coalesce(control = 'true', false) AS regulating FROM places WHERE type = 'StaticVarCompensator'"
)
def c_svcs(grid):
    return Conversion(grid).svcs()


@query(
    f"""{_REACH}, fuels AS (SELECT fuel_unit, arg_max(split_part(fuel, '.', -1), doc_pos) AS fuel FROM o WHERE type = 'FossilFuel' AND contains(fuel, '#') GROUP BY fuel_unit),
    curves AS (SELECT of_curve, string_agg(xvalue || '/' || coalesce(y1, '0') || '/' || y2, ',' ORDER BY doc_pos) AS points FROM o WHERE type = 'CurveData' GROUP BY of_curve)
    SELECT p.model, p.place AS vl, p.doc_pos, p.eq_mrid AS mrid, p.name, p.node, CASE u.type WHEN 'HydroGeneratingUnit' THEN 'HYDRO' WHEN 'ThermalGeneratingUnit' THEN 'THERMAL' WHEN 'WindGeneratingUnit' THEN 'WIND' WHEN 'SolarGeneratingUnit' THEN 'SOLAR' ELSE 'OTHER' END AS energy_source,
    u.minp::DOUBLE AS min_p, u.maxp::DOUBLE AS max_p, p.rated_s::DOUBLE AS rated_s, p.control = 'true' AS regulating, coalesce(contains(p.machine_kind, 'ondenser'), false) AS condenser, CASE WHEN t.equipment IS DISTINCT FROM p.id THEN r.bbs END AS regulating_terminal, c.points,
    CASE WHEN c.points IS NULL AND p.minq IS NOT NULL AND p.maxq IS NOT NULL THEN p.minq::DOUBLE END AS min_q, CASE WHEN c.points IS NULL AND p.minq IS NOT NULL AND p.maxq IS NOT NULL THEN p.maxq::DOUBLE END AS max_q, substr(p.t_id, 2) AS terminal1,
    concat_ws(';', 'CGMES.fuelType=' || f.fuel, 'CGMES.synchronousMachineType=' || split_part(p.machine_kind, '.', -1), 'CGMES.mode=' || lower(g.control_mode), 'CGMES.originalClass=SynchronousMachine', 'CGMES.GeneratingUnit=' || u.mrid_or_id, 'CGMES.RegulatingControl=' || g.mrid_or_id,
              'CGMES.windGenUnitType=' || CASE WHEN u.type = 'WindGeneratingUnit' THEN split_part(u.wind, '.', -1) END) AS properties
    FROM places p LEFT JOIN o u ON u.id = p.unit LEFT JOIN fuels f ON f.fuel_unit = p.unit LEFT JOIN o g ON g.id = p.control_ref LEFT JOIN terminals t ON t.id = g.control_terminal LEFT JOIN reach r ON r.cn = t.cn LEFT JOIN curves c ON c.of_curve = p.curve WHERE p.type = 'SynchronousMachine'"""
)
def c_generators(grid):
    point = lambda x: F.concat_ws("/", *[x[c].cast("long").cast("string") for c in ("p", "min_q", "max_q")])
    rows = Conversion(grid).generators().withColumns({"points": F.array_join(F.transform("points", point), ","), "properties": _named("properties")})
    return rows.select("*", "limits.min_q", "limits.max_q").drop("limits")


@query("SELECT 'star' AS model, of_curve AS curve, row_number() OVER (PARTITION BY of_curve ORDER BY doc_pos)::INTEGER AS nth, xvalue::DOUBLE AS p, coalesce(y1::DOUBLE, 0) AS min_q, y2::DOUBLE AS max_q FROM o WHERE type = 'CurveData'")
def a_curve_points(grid):
    rows = Index(grid).curve_points.select("model", "curve", F.posexplode("points").alias("nth", "x"))
    return rows.select("model", "curve", (F.col("nth") + 1).alias("nth"), "x.p", "x.min_q", "x.max_q")


@query(
    f"""{_MORE} SELECT e.model, (e.type = 'SeriesCompensator')::INTEGER AS class_rank, e.doc_pos, e.mrid_or_id AS mrid, e.name, e.type AS original_class, trim(coalesce(e.line_r, e.series_r))::DOUBLE AS r, coalesce(e.line_x, e.series_x)::DOUBLE AS x,
    coalesce(e.gch::DOUBLE, 0) / 2 AS g1, coalesce(e.bch::DOUBLE, 0) / 2 AS b1, coalesce(e.gch::DOUBLE, 0) / 2 AS g2, coalesce(e.bch::DOUBLE, 0) / 2 AS b2, a.vl AS vl1, a.node AS node1, b.vl AS vl2, b.node AS node2, substr(t1.id, 2) AS terminal1, substr(t2.id, 2) AS terminal2, g.groups AS groups1, h.groups AS groups2
    FROM o e JOIN terminals t1 ON t1.equipment = e.id AND t1.nth = 1 AND t1.n = 2 JOIN terminals t2 ON t2.equipment = e.id AND t2.nth = 2 JOIN line_ends a ON a.terminal = t1.id JOIN line_ends b ON b.terminal = t2.id LEFT JOIN groups g ON g.terminal = t1.id LEFT JOIN groups h ON h.terminal = t2.id
    WHERE e.type IN ('ACLineSegment', 'SeriesCompensator')"""
)
def c_lines(grid):
    group = lambda g: F.concat(g["id"], F.lit("{"), _named(g["properties"]), F.lit("}"), F.coalesce(g["permanent"].cast("string"), F.lit("")))
    text = lambda c: F.array_join(F.transform(c, group), ",")
    return Conversion(grid).lines().withColumns({"groups1": text("groups1"), "groups2": text("groups2")})


@query(f"{_MORE} SELECT 'star' AS model, terminal, vl AS vl_mrid, node FROM line_ends")
def j_line_placement(grid):
    return Conversion(grid).line_places()


@query(f"{_MORE} SELECT 'star' AS model, cn, cn_pos, container, id AS terminal, equipment, node FROM outside")
def w_fict_nodes(grid):
    return Conversion(grid).boundary_terminals


@query(f"{_MORE} SELECT 'star' AS model, cn, cn_pos, id, name, nominal_v, container, terminals FROM fict")
def c_fict_vl(grid):
    return Conversion(grid).fictitious_levels


@query(
    f"{_MORE} SELECT e.model, f.id AS vl, e.doc_pos, e.mrid_or_id AS mrid, 'BoundaryInjectionEq' AS name, 0 AS node, -1.7976931348623157e308::DOUBLE AS min_p, 1.7976931348623157e308::DOUBLE AS max_p, substr(t.id, 2) AS terminal1 FROM o e JOIN terminals t ON t.equipment = e.id AND t.nth = 1 JOIN fict f ON f.cn = t.cn WHERE e.type = 'EquivalentInjection'"
)
def c_boundary_gen(grid):
    return Conversion(grid).boundary_generators()


@query(f"""{_MORE} SELECT 'star' AS model, transformer, id AS "end", nth::INTEGER AS nth, n, vl, vl_mrid, node, u AS rated_u, r, x, g, b, s AS rated_s FROM tp""")
def j_transformer_ends(grid):
    return Conversion(grid).transformer_ends


@query(
    f"""{_MORE} SELECT 'star' AS model, a.substation, t.doc_pos, t.mrid_or_id AS mrid, t.name, a.r * ((b.u / a.u) * (b.u / a.u)) AS r, a.x * ((b.u / a.u) * (b.u / a.u)) AS x, a.g / ((b.u / a.u) * (b.u / a.u)) AS g, a.b / ((b.u / a.u) * (b.u / a.u)) AS b,
    a.u AS rated_u1, b.u AS rated_u2, a.s AS rated_s, a.vl_mrid AS vl1, a.node AS node1, b.vl_mrid AS vl2, b.node AS node2, coalesce(r1.position, r2.position) AS ratio_position, coalesce(r1.n, r2.n) AS ratio_steps, coalesce(p1.position, p2.position) AS phase_position, coalesce(p1.n, p2.n) AS phase_steps
    FROM o t JOIN tp a ON a.transformer = t.id AND a.nth = 1 AND a.n = 2 JOIN tp b ON b.transformer = t.id AND b.nth = 2 LEFT JOIN changers r1 ON r1.tap_end = a.id AND NOT r1.phase LEFT JOIN changers r2 ON r2.tap_end = b.id AND NOT r2.phase
    LEFT JOIN changers p1 ON p1.tap_end = a.id AND p1.phase LEFT JOIN changers p2 ON p2.tap_end = b.id AND p2.phase WHERE t.type = 'PowerTransformer' AND a.usable AND b.usable"""
)
def c_xf2(grid):
    tap = lambda k: (F.col(f"{k}_tap_changer.position").alias(f"{k}_position"), F.size(F.col(f"{k}_tap_changer.steps")).alias(f"{k}_steps"))
    return Conversion(grid).two_windings().select("*", *tap("ratio"), *tap("phase")).drop("ratio_tap_changer", "phase_tap_changer")


_leg = lambda k: ", ".join(f"e{k}.{c} AS {n}{k}" for c, n in (("r", "r"), ("x", "x"), ("g", "g"), ("b", "b"), ("u", "rated_u"), ("s", "rated_s"), ("vl_mrid", "vl"), ("node", "node"))) + f", c{k}.position AS position{k}, c{k}.n AS steps{k}"


@query(
    f"""{_MORE} SELECT 'star' AS model, e1.substation, t.doc_pos, t.mrid_or_id AS mrid, t.name, e1.u AS rated_u0, {_leg(1)}, {_leg(2)}, {_leg(3)} FROM o t {" ".join(f"JOIN tp e{k} ON e{k}.transformer = t.id AND e{k}.nth = {k} AND e{k}.n = 3 AND e{k}.usable LEFT JOIN changers c{k} ON c{k}.tap_end = e{k}.id AND NOT c{k}.phase" for k in (1, 2, 3))}
    WHERE t.type = 'PowerTransformer'"""
)
def c_xf3(grid):
    leg = lambda k: [F.col(f"e{k}.{c}").alias(f"{n}{k}") for c, n in (("r", "r"), ("x", "x"), ("g", "g"), ("b", "b"), ("rated_u", "rated_u"), ("rated_s", "rated_s"), ("vl_mrid", "vl"), ("node", "node"))]
    tap = lambda k: [F.col(f"ratio{k}.position").alias(f"position{k}"), F.size(F.col(f"ratio{k}.steps")).alias(f"steps{k}")]
    return Conversion(grid).three_windings().select("model", "substation", "doc_pos", "mrid", "name", "rated_u0", *(c for k in (1, 2, 3) for c in [*leg(k), *tap(k)]))


def _steps(grid, phase: bool) -> DataFrame:
    rows = Conversion(grid).tap_changers.where(F.col("phase") == phase).select("model", "end", "low", "position", "ltc", F.posexplode("steps").alias("nth", "s"))
    return rows.select("model", "end", "low", "position", "ltc", (F.col("nth") + 1).alias("nth"), "s.r", "s.x", "s.rho", "s.alpha")


@query(f"""{_MORE} SELECT 'star' AS model, tap_end AS "end", low, position, ltc, nth, r, x, rho, alpha FROM steps WHERE NOT phase""")
def c_ratio_tc(grid):
    return _steps(grid, False)


@query(f"""{_MORE} SELECT 'star' AS model, tap_end AS "end", low, position, ltc, nth, r, x, rho, alpha FROM steps WHERE phase""")
def c_phase_tc(grid):
    return _steps(grid, True)


@query(
    """, tied AS (SELECT a.id, f.doc_pos, e.mrid_or_id || ':' || CASE t.seq WHEN 1 THEN 'ONE' ELSE 'TWO' END AS side FROM o f JOIN o a ON a.type = 'ControlArea' AND (f.area = a.id OR f.area = a.mrid_or_id) JOIN terminals t ON t.id = f.flow_terminal JOIN o e ON e.id = t.equipment WHERE f.type = 'TieFlow')
    SELECT a.model, a.doc_pos, a.mrid_or_id AS mrid, coalesce(a.name, a.mrid_or_id) AS name, coalesce(split_part(a.area_kind, '#', -1), 'ControlAreaTypeKind.Interchange') AS area_type, (SELECT string_agg(side, ',' ORDER BY doc_pos) FROM tied WHERE tied.id = a.id) AS boundaries FROM o a WHERE a.type = 'ControlArea'"""
)
def c_areas(grid):
    return Conversion(grid).areas().withColumn("boundaries", _named("boundaries", ":", ",", "id", "side"))


@query(
    """, said AS (SELECT subj_pos, max(text) FILTER (WHERE pred = 'TapChanger.normalStep') AS step, max(text) FILTER (WHERE pred = 'IdentifiedObject.mRID') AS mrid, max(substr(ref, 2)) AS target FROM tagrows GROUP BY subj_pos),
    transformers AS (SELECT id, coalesce(mrid, substr(id, 2)) AS mrid FROM objects LEFT JOIN said ON subj_pos = doc_pos WHERE type = 'PowerTransformer'),
    ends AS (SELECT e.id, x.mrid AS transformer FROM objects e JOIN said ON subj_pos = doc_pos JOIN transformers x ON x.id = target WHERE e.type = 'PowerTransformerEnd')
    SELECT t.model, e.transformer, (t.type LIKE 'Phase%')::INTEGER AS rank, t.doc_pos, substr(t.id, 2) AS id, CASE WHEN t.type LIKE 'Phase%' THEN t.type END AS type, step::INTEGER AS step FROM objects t JOIN said ON subj_pos = doc_pos JOIN ends e ON e.id = target WHERE t.type IN ('RatioTapChanger', 'PhaseTapChangerTabular') AND step IS NOT NULL""",
    narrow_ctes({"RatioTapChanger.TransformerEnd", "PhaseTapChanger.TransformerEnd", "TapChanger.normalStep", "PowerTransformerEnd.PowerTransformer", "IdentifiedObject.mRID"}),
)
def c_ext_tap_changers(grid):
    return Conversion(grid).tap_changer_extensions()


@query("SELECT model, doc_pos, mrid_or_id AS id, q_percent::DOUBLE AS q_percent FROM o WHERE type = 'SynchronousMachine' AND q_percent IS NOT NULL")
def c_ext_reactive(grid):
    return Conversion(grid).reactive_extensions()


@query(
    """, listed AS (SELECT subj_pos, string_agg(text, ',' ORDER BY pos) FILTER (WHERE pred = 'Model.profile') AS profiles, string_agg(ref, ',' ORDER BY pos) FILTER (WHERE pred = 'Model.DependentOn') AS dependent_on FROM tagrows GROUP BY subj_pos)
    SELECT m.model, (CASE row_number() OVER (ORDER BY doc_pos) WHEN 1 THEN 2147483647 ELSE row_number() OVER (ORDER BY doc_pos) END)::INTEGER AS nth, m.id, CASE WHEN contains(profiles, 'CoreEquipment') THEN 'EQUIPMENT' ELSE 'UNKNOWN' END AS subset, authority,
    replace(replace(replace(description, '+', ' '), '&lt;', '<'), '&gt;', '>') AS description, coalesce(version::INTEGER, 0) AS version, profiles, dependent_on FROM o m JOIN listed l ON l.subj_pos = m.doc_pos WHERE m.type = 'FullModel'"""
)
def a_metadata_models(grid):
    return Conversion(grid).metadata_models().withColumns({"profiles": F.array_join("profiles", ","), "dependent_on": F.array_join("dependent_on", ",")})


@query("SELECT v.model, v.doc_pos, v.mrid_or_id AS id, v.nominal::DOUBLE AS nominal_v, CASE WHEN v.doc_pos > (SELECT max(doc_pos) FROM o WHERE type = 'FullModel') THEN 'BOUNDARY' ELSE 'IGM' END AS source FROM o v WHERE v.type = 'BaseVoltage'")
def a_base_voltage_map(grid):
    return Conversion(grid).base_voltages()


_counted = {
    "Substations": "SELECT s.id FROM o s LEFT JOIN sub_merge m ON m.id = s.id WHERE s.type = 'Substation' AND (m.id IS NULL OR m.representative = s.id)", "VoltageLevels": "SELECT vl FROM kept", "BusbarSections": "SELECT id FROM places WHERE type = 'BusbarSection'",
    "Switches": f"SELECT p.id FROM places p JOIN terminals t ON t.equipment = p.id AND t.nth = 2 JOIN node_map n ON n.terminal = t.id WHERE p.type IN ({_switches})", "Loads": "SELECT id FROM places WHERE type IN ('EnergyConsumer', 'ConformLoad', 'NonConformLoad')",
    "Shunts": "SELECT id FROM places WHERE type = 'LinearShuntCompensator'", "StaticVarCompensators": "SELECT id FROM places WHERE type = 'StaticVarCompensator'", "Generators": "SELECT id FROM places WHERE type = 'SynchronousMachine'",
    **{f"{n}-winding transformers": f"SELECT transformer FROM tp WHERE n = {n} GROUP BY transformer HAVING bool_and(usable)" for n in (2, 3)},
    "Lines": "SELECT e.id FROM o e JOIN terminals t ON t.equipment = e.id AND t.n = 2 JOIN line_ends l ON l.terminal = t.id WHERE e.type IN ('ACLineSegment', 'SeriesCompensator') GROUP BY e.id HAVING count(*) = 2",
}


@query(f"{_MORE} " + " UNION ALL ".join(f"SELECT 'star' AS model, {i} AS nth, '{metric}' AS metric, count(*) AS n FROM ({rows}) x" for i, (metric, rows) in enumerate(_counted.items())))
def a_convert_totals(grid):
    return Conversion(grid).totals()


# The network's document


@query(
    """, m AS (SELECT model, id, scenario, greatest(0, floor((epoch(scenario::TIMESTAMP) - epoch(created::TIMESTAMP)) / 60))::BIGINT AS ahead FROM o WHERE type = 'FullModel' ORDER BY doc_pos LIMIT 1),
    there AS (
      SELECT 0 AS k, 'cgmesTapChangers' AS name, EXISTS (SELECT 1 FROM o t JOIN o e ON e.id = coalesce(t.ratio_end, t.phase_end) JOIN o x ON x.id = e.transformer AND x.type = 'PowerTransformer' WHERE t.type IN ('RatioTapChanger', 'PhaseTapChangerTabular') AND t.normal_step IS NOT NULL) AS yes
      UNION ALL SELECT 1, 'detail', EXISTS (SELECT 1 FROM places WHERE type IN ('EnergyConsumer', 'ConformLoad', 'NonConformLoad')) UNION ALL SELECT 2, 'coordinatedReactiveControl', EXISTS (SELECT 1 FROM o WHERE type = 'SynchronousMachine' AND q_percent IS NOT NULL)
      UNION ALL SELECT 3, 'cgmesMetadataModels', EXISTS (SELECT 1 FROM m) UNION ALL SELECT 4, 'baseVoltageMapping', EXISTS (SELECT 1 FROM o WHERE type = 'BaseVoltage') UNION ALL SELECT 5, 'cimCharacteristics', true
    ) SELECT model, '{"version":"1.15","extensionVersions":[' || (SELECT string_agg('{"extensionName":"' || name || '","version":"1.0"}', ',' ORDER BY k) FROM there WHERE yes) || '],"id":"' || id || '","caseDate":"' || replace(scenario, 'Z', '.000Z') || '","forecastDistance":' || ahead || ',"sourceFormat":"CGMES","minimumValidationLevel":"EQUIPMENT"' AS head FROM m"""
)
def a_ext_versions(grid):
    return sinks.NetworkJson(Conversion(grid)).heads()


@query(
    """SELECT model, doc_pos, '{"id":"' || eq_mrid || '","detail":{"fixedActivePower":0.0,"fixedReactivePower":0.0,"variableActivePower":0.0,"variableReactivePower":0.0}}' AS json FROM places WHERE type IN ('EnergyConsumer', 'ConformLoad', 'NonConformLoad')"""
)
def a_detail_ext(grid):
    return sinks.NetworkJson(Conversion(grid)).extension(1).select("model", "doc_pos", "json")


@query(
    """, listed AS (SELECT subj_pos, string_agg('{"content":"' || text || '"}', ',' ORDER BY pos) FILTER (WHERE pred = 'Model.profile') AS profiles, contains(string_agg(text, ',') FILTER (WHERE pred = 'Model.profile'), 'CoreEquipment') AS core, string_agg('{"content":"' || ref || '"}', ',' ORDER BY pos) FILTER (WHERE pred = 'Model.DependentOn') AS dependent FROM tagrows GROUP BY subj_pos),
    models AS (
      SELECT string_agg('{"subset":"' || CASE WHEN core THEN 'EQUIPMENT' ELSE 'UNKNOWN' END || '","modelingAuthoritySet":"' || authority || '","id":"' || id || '","version":' || coalesce(version::INTEGER, 0) || ',"description":"' || replace(replace(replace(description, '+', ' '), '&lt;', '<'), '&gt;', '>') || '","profiles":[' || coalesce(profiles, '') || '],"dependentOnModels":[' || coalesce(dependent, '') || ']}', ',' ORDER BY nth) AS json
      FROM (SELECT o.*, l.*, CASE row_number() OVER (ORDER BY doc_pos) WHEN 1 THEN 2147483647 ELSE row_number() OVER (ORDER BY doc_pos) END AS nth FROM o JOIN listed l ON l.subj_pos = o.doc_pos WHERE type = 'FullModel') x
    ), voltages AS (
      SELECT string_agg('{"nominalVoltage":' || nominal::DOUBLE::VARCHAR || ',"source":"' || CASE WHEN doc_pos > (SELECT max(doc_pos) FROM o WHERE type = 'FullModel') THEN 'BOUNDARY' ELSE 'IGM' END || '","id":"' || mrid_or_id || '"}', ',' ORDER BY nominal::DOUBLE, doc_pos) AS json FROM o WHERE type = 'BaseVoltage'
    ) SELECT model, '{"id":"' || id || '","cgmesMetadataModels":{"models":[' || models.json || ']},"baseVoltageMapping":{"baseVoltages":[' || voltages.json || ']},"cimCharacteristics":{"topologyKind":"NODE_BREAKER","cimVersion":100}}' AS json FROM (SELECT model, id FROM o WHERE type = 'FullModel' ORDER BY doc_pos LIMIT 1) x, models, voltages"""
)
def s_bv_sort(grid):
    return sinks.NetworkJson(Conversion(grid)).extension(3).select("model", "json")


@query(
    f"""{_MORE}, members AS (
      SELECT 0 AS section, 0 AS rank, s.doc_pos, s.mrid_or_id AS id, count(k.vl) AS levels FROM o s JOIN kept k ON k.substation = s.id LEFT JOIN sub_merge m ON m.id = s.id WHERE s.type = 'Substation' AND (m.id IS NULL OR m.representative = s.id) GROUP BY ALL
      UNION ALL SELECT 1, 0, cn_pos, id, 0 FROM fict
      UNION ALL SELECT 2, (e.type = 'SeriesCompensator')::INTEGER, e.doc_pos, e.mrid_or_id, 0 FROM o e JOIN terminals t ON t.equipment = e.id AND t.n = 2 JOIN line_ends l ON l.terminal = t.id WHERE e.type IN ('ACLineSegment', 'SeriesCompensator') GROUP BY e.type, e.doc_pos, e.mrid_or_id HAVING count(*) = 2
      UNION ALL SELECT 3, 0, doc_pos, mrid_or_id, 0 FROM o WHERE type = 'ControlArea'
      UNION ALL SELECT 4, 0, min(t.doc_pos), x.mrid_or_id, 0 FROM o t JOIN o e ON e.id = coalesce(t.ratio_end, t.phase_end) JOIN o x ON x.id = e.transformer AND x.type = 'PowerTransformer' WHERE t.type IN ('RatioTapChanger', 'PhaseTapChangerTabular') AND t.normal_step IS NOT NULL GROUP BY x.mrid_or_id
      UNION ALL SELECT 4, 1, doc_pos, eq_mrid, 0 FROM places WHERE type IN ('EnergyConsumer', 'ConformLoad', 'NonConformLoad')
      UNION ALL SELECT 4, 2, doc_pos, mrid_or_id, 0 FROM o WHERE type = 'SynchronousMachine' AND q_percent IS NOT NULL
      UNION ALL (SELECT 4, 3, 0, id, 0 FROM o WHERE type = 'FullModel' ORDER BY doc_pos LIMIT 1)
    ) SELECT 'star' AS model, section, rank, doc_pos, id, levels, row_number() OVER (PARTITION BY section ORDER BY rank, doc_pos) = 1 AS opens FROM members"""
)
def sink_json_network(grid):
    """Every fragment of the document: its place, whose it is, its voltage levels and whether it opens its list; a member is read back as JSON."""
    rows = sinks.NetworkJson(Conversion(grid)).fragments().where(f"section < {len(sinks.SECTIONS)}")
    opens = ~F.col("value").startswith(",{")
    member = F.concat(F.regexp_extract("value", r'^(?:,|.*?"(?:' + "|".join(n for n, _ in sinks.SECTIONS) + r')":\[)(?=\{"id":)(.*)$', 1), F.lit(sinks.END))
    levels = F.when(F.col("section") == 0, F.json_array_length(F.get_json_object(member, "$.voltageLevels"))).otherwise(0)
    return rows.select("model", "section", "rank", "doc_pos", F.get_json_object(member, "$.id").alias("id"), levels.cast("long").alias("levels"), opens.alias("opens"))


# Models in XML


def _tags(grid) -> DataFrame:
    """Tags of the star model as four models, written as packed XML files, each of which is read in one split."""
    return splits.read_tags(grid.spark, write_models(grid, new_path(grid.spark, "star-xml"), compression="gzip"))


def _closed(grid) -> DataFrame:
    return rdfxml.closed(_tags(grid), in_order=True)


@query(
    """, sized AS (
      SELECT 'm' || (doc_pos % 4) AS model, doc_pos, id, type, 2 + coalesce((count(text) + count(t.subj_pos))::BIGINT, 0) AS tags FROM objects LEFT JOIN tagrows t ON t.subj_pos = doc_pos GROUP BY ALL
    ), ends AS (SELECT *, 1 + (sum(tags) OVER (PARTITION BY model ORDER BY doc_pos))::BIGINT AS close_pos FROM sized)
    SELECT model, close_pos - tags + 1 AS doc_pos, close_pos, id, type, 'EQ' AS src_part FROM ends"""
)
def scan_objects(grid):
    return rdfxml.objects(_closed(grid))


@query("SELECT 'm' || (subj_pos % 4) AS model, subj, pred, text, ref FROM tagrows")
def scan_triples(grid):
    closed = _closed(grid)
    return rdfxml.triples(closed, rdfxml.objects(closed)).select("model", "subj", "pred", "text", "ref")


# Tags and scalar functions


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select(F.col("page_id").cast("string").alias("model"), F.lit("EQ").alias("part"), F.col("html").alias("content"))


@table_query(
    r"""SELECT page_id::VARCHAR AS model, count(*) AS n, count(*) FILTER (WHERE t LIKE '/%') AS closers FROM (SELECT page_id, unnest(string_split(html, '<')[2:]) AS t FROM pages) WHERE t NOT LIKE '!%' AND t NOT LIKE '?%' GROUP BY page_id"""
)
def scan_tags(spark, sf_dir):
    return rdfxml.tags(_pages(spark, sf_dir)).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("tag").startswith("/")).alias("closers"))


@table_query(r"""SELECT page_id::VARCHAR AS model, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS value FROM pages""")
def scan_pattern(spark, sf_dir):
    return _pages(spark, sf_dir).select("model", F.explode(rdfxml.attributes(F.col("content"), "href")).alias("value"))


@table_query(
    r"""WITH s AS (SELECT page_id::VARCHAR AS model, string_split(html, 'href="') AS l FROM pages), u AS (SELECT model, unnest(l) AS rest, generate_subscripts(l, 1) - 1 AS nth FROM s),
    p AS (SELECT *, (sum(strlen(rest)) OVER (PARTITION BY model ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT + 6 * nth AS value_start FROM u)
    SELECT model, 'EQ' AS part, value_start - 6 AS start, value_start, strlen(split_part(rest, '"', 1)) AS value_len, split_part(rest, '"', 1) AS value FROM p WHERE nth > 0 AND contains(rest, '"')"""
)
def scan_pattern_positions(spark, sf_dir):
    return rdfxml.attribute_positions(_pages(spark, sf_dir), "href")


@query("SELECT 'm' || (doc_pos % 4) AS model, 1::BIGINT AS pos, 2 + sum(tags)::BIGINT AS close_pos FROM (SELECT doc_pos, 2 + count(text) + count(t.subj_pos) AS tags FROM objects LEFT JOIN tagrows t ON t.subj_pos = doc_pos GROUP BY doc_pos) x GROUP BY ALL")
def scan_close_one(grid):
    return rdfxml.closing_tag(_tags(grid), F.col("pos") == 1)


def scan_close_index(spark, sf_dir):
    """Closing positions of the pages' tags, by the stack rule (SQL has none)."""
    return rdfxml.closed(rdfxml.tags(_pages(spark, sf_dir)), namespaced=False).select("model", "pos", "name", "kind", "close_pos")


QUERIES["scan_close_index"] = scan_close_index


@table_query("SELECT o_orderkey AS k, epoch(o_orderdate)::BIGINT + o_orderkey % 60 AS seconds, strftime(o_orderdate, '%Y-%m-%dT%H:%M:') || lpad((o_orderkey % 60)::VARCHAR, 2, '0') || '.000Z' AS millis FROM orders")
def f_iso_seconds(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:"), F.lpad((F.col("o_orderkey") % 60).cast("string"), 2, "0"), F.lit("Z"))
    return orders.select(F.col("o_orderkey").alias("k"), S.iso_seconds(text).alias("seconds"), S.date_millis(text).alias("millis"))


@table_query("SELECT p_partkey AS k, CASE WHEN p_size % 2 = 0 THEN (p_size // 2)::VARCHAR || '.0' ELSE (p_size // 2)::VARCHAR || '.5' END AS plain, (p_size * 10000000)::VARCHAR || '.0' AS large FROM part")
def f_float_json(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.col("p_partkey").alias("k"), S.float_json(F.col("p_size") / 2).alias("plain"), S.float_json(F.col("p_size") * F.lit(1e7)).alias("large"))


@table_query(
    """WITH x AS (SELECT p_partkey AS k, (p_size::BIGINT * 100000000)::VARCHAR AS t, p_size % 3 = 0 AS third FROM part), d AS (SELECT *, rtrim(t, '0') AS digits FROM x), e AS (SELECT *, substr(digits, 1, 1) || CASE WHEN length(digits) > 1 THEN '.' || substr(digits, 2) ELSE '' END || 'E' || (length(t) - 1) AS sci FROM d)
    SELECT k, '-' || sci AS sci, CASE WHEN length(t) > 10 THEN sci ELSE t || '.0' END AS automatic, CASE WHEN third THEN t || '0.0' ELSE t || '.0' END AS given FROM e"""
)
def f_float_sci(spark, sf_dir):
    size = F.col("p_size") * F.lit(1e8)
    text = size.cast("decimal(30,0)").cast("string")
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    given = F.when(F.col("p_size") % 3 == 0, F.concat(text, F.lit("e1"))).otherwise(text)
    return part.select(F.col("p_partkey").alias("k"), S.float_scientific(-size).alias("sci"), S.float_auto(size).alias("automatic"), S.float_text(given).alias("given"))


@table_query("SELECT DISTINCT event_type AS v, split_part(event_type, '.', -1) AS fragment, replace(replace('<' || event_type || '>&', '+', ' '), 'x', 'x') AS decoded, substr(event_type, 2) AS stripped FROM events")
def f_enum_fragment(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("v")).distinct()
    url = F.concat(F.lit("http://c#Kind."), F.col("v"))
    coded = F.concat(F.lit("&lt;"), F.col("v"), F.lit("&gt;&amp;"))
    return events.select("v", S.enum_fragment(url).alias("fragment"), S.decode_entities(coded).alias("decoded"), F.substring(S.strip_hash(F.concat(F.lit("#"), F.col("v"))), 2, 2**31 - 1).alias("stripped"))
