"""Derived tables of a grid that the conversion probes: terminals, containers, limits, merges, node numbers."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweft.functions.scalars import is_true, number, strip_underscore, trimmed, whole
from gridweft.operators.access import MRID, Grid
from gridweft.operators.components import connected_components
from gridweft.storage import bucketed, stored

#: Switch classes, in order.
SWITCHES = ["Breaker", "Disconnector", "LoadBreakSwitch"]
#: Load classes, in order.
LOADS = ["EnergyConsumer", "ConformLoad", "NonConformLoad"]
#: Classes whose terminals are numbered, in order.
NUMBERED = ["ACLineSegment", "PowerTransformer", "SynchronousMachine", "EnergyConsumer", "ConformLoad", "NonConformLoad", "LinearShuntCompensator", "StaticVarCompensator", "SeriesCompensator"]
BUSBAR = "BusbarSection"
#: Line classes, in order.
LINES = ["ACLineSegment", "SeriesCompensator"]


def class_rank(c: Column, classes: list[str]) -> Column:
    """Place of a class in a list, from 0; null for others."""
    at = F.array_position(F.array(*[F.lit(x) for x in classes]), c)
    return F.when(at > 0, at - 1).cast("int")


def _joined(model: Column, node: Column) -> Column:
    return F.concat_ws("\x1f", model, node)


def components_by_model(edges: DataFrame) -> DataFrame:
    """(model, id, component) for edges (model, a, b): a component's name is its smallest id."""
    keyed = edges.select(_joined(F.col("model"), F.col("a")).alias("a"), _joined(F.col("model"), F.col("b")).alias("b"))
    part = lambda c, n: F.element_at(F.split(c, "\x1f"), n)
    return connected_components(stored(keyed, "edges")).select(part("node", 1).alias("model"), part("node", 2).alias("id"), part("component", 2).alias("component"))


class Index:
    """Derived tables of a Grid; each is computed when first asked for, those with many readers are stored.

    ``strict`` makes missing mandatory references an error; else such rows are left out.
    """

    def __init__(self, grid: Grid, strict: bool = False):
        self.grid, self.strict = grid, strict

    def _mandatory(self, rows: DataFrame, column: str, what: str) -> DataFrame:
        if not self.strict:
            return rows.where(F.col(column).isNotNull())
        error = F.raise_error(F.concat(F.lit(f"{what} is missing: "), "id"))
        return rows.withColumn(column, F.when(F.col(column).isNull(), error).otherwise(F.col(column)))

    @cached_property
    def terminal_rows(self) -> DataFrame:
        """(model, id, doc_pos, equipment, cn, seq, eq_type, eq_pos) of terminals, with the class and position of their equipment."""
        rows = self.grid.referring(["Terminal"], {"seq": "ACDCTerminal.sequenceNumber"}, {"equipment": "Terminal.ConductingEquipment", "cn": "Terminal.ConnectivityNode"}, "equipment")
        rows = self._mandatory(rows, "equipment", "Terminal.ConductingEquipment").withColumn("seq", F.coalesce(whole(F.col("seq")), F.lit(1)))
        rows = rows.select("model", "id", "doc_pos", "equipment", "cn", "seq", F.col("equipment_type").alias("eq_type"), F.col("equipment_pos").alias("eq_pos"))
        # Readers take the terminals of some classes; an error must come for any of them.
        return stored(rows, "terminals") if self.strict else rows

    def terminals_of(self, *types: str) -> DataFrame:
        """terminal_rows of equipment of classes, of all if none is named, with nth of n terminals by sequence and document order.

        All terminals of a piece of equipment have one class, so that a class is taken before the shuffle.
        """
        rows = self.terminal_rows.where(F.col("eq_type").isin(*types)) if types else self.terminal_rows
        own = Window.partitionBy("model", "equipment")
        return rows.withColumns({"nth": F.row_number().over(own.orderBy("seq", "doc_pos")), "n": F.count(F.lit(1)).over(own)})

    @property
    def terminals(self) -> DataFrame:
        """(model, id, doc_pos, equipment, cn, seq, eq_type, eq_pos, nth, n) of all terminals."""
        return self.terminals_of()

    @cached_property
    def containers(self) -> DataFrame:
        """(model, cn, cn_pos, container): a bay stands for its voltage level."""
        rows = self.grid.view(["ConnectivityNode"], {}, {"container": "ConnectivityNode.ConnectivityNodeContainer"})
        rows = self._mandatory(rows, "container", "ConnectivityNode.ConnectivityNodeContainer")
        bays = self.grid.view(["Bay"], {}, {"bay_vl": "Bay.VoltageLevel"}).select("model", F.col("id").alias("container"), "bay_vl")
        found = rows.join(bays, ["model", "container"], "left")
        return bucketed(found.select("model", F.col("id").alias("cn"), F.col("doc_pos").alias("cn_pos"), F.coalesce("bay_vl", "container").alias("container")), "containers", "model", "cn")

    @cached_property
    def busbars(self) -> DataFrame:
        """(model, cn, bbs): the last busbar section, by its mRID, with exactly one terminal on a node."""
        one = self.terminals_of(BUSBAR).where((F.col("n") == 1) & F.col("cn").isNotNull())
        names = self.grid.named([BUSBAR]).select("model", F.col("id").alias("equipment"), "mrid")
        return one.join(names, ["model", "equipment"]).groupBy("model", "cn").agg(F.max_by("mrid", "eq_pos").alias("bbs"))

    @cached_property
    def switch_ends(self) -> DataFrame:
        """(model, id, eq_pos, cn1, cn2) of switches with exactly two terminals, both on a node; open or closed."""
        ends = self.terminals_of(*SWITCHES).where(F.col("n") == 2)
        at = lambda k: F.max(F.when(F.col("nth") == k, F.col("cn")))
        return ends.groupBy("model", F.col("equipment").alias("id"), "eq_pos").agg(at(1).alias("cn1"), at(2).alias("cn2")).where("cn1 IS NOT NULL AND cn2 IS NOT NULL")

    def _in(self, rows: DataFrame, column: str, out: str) -> DataFrame:
        return rows.join(self.containers.select("model", F.col("cn").alias(column), F.col("container").alias(out)), ["model", column])

    @cached_property
    def vl_merge(self) -> DataFrame:
        """(model, id, representative) of voltage levels that switches join; the representative has the smallest mRID."""
        levels = self.grid.named(["VoltageLevel"]).select("model", "id", "mrid")
        edges = self._in(self._in(self.switch_ends, "cn1", "a"), "cn2", "b").where("a <> b").select("model", "a", "b").distinct()
        for end in ("a", "b"):
            edges = edges.join(levels.select("model", F.col("id").alias(end)), ["model", end], "left_semi")
        found = components_by_model(edges).join(levels, ["model", "id"])
        least = found.groupBy("model", "component").agg(F.min_by("id", F.struct("mrid", "id")).alias("representative"))
        return bucketed(found.join(least, ["model", "component"]).select("model", "id", "representative"), "vl-merge", "model", "id")

    @cached_property
    def substation_merge(self) -> DataFrame:
        """(model, id, representative) of substations that merged levels or transformers join; the smallest id without underscore."""
        homes = self.grid.view(["VoltageLevel"], {}, {"home": "VoltageLevel.Substation"}).where("home IS NOT NULL").select("model", "id", "home")
        by_level = self.vl_merge.join(homes, ["model", "id"]).join(homes.select("model", F.col("id").alias("representative"), F.col("home").alias("b")), ["model", "representative"])
        ends = self.terminals_of("PowerTransformer").where(F.col("cn").isNotNull())
        sited = self._in(ends, "cn", "vl").join(homes.withColumnRenamed("id", "vl"), ["model", "vl"])
        first = sited.groupBy("model", "equipment").agg(F.min_by("home", "nth").alias("b"))
        by_transformer = sited.join(first, ["model", "equipment"])
        edges = by_level.select("model", F.col("home").alias("a"), "b").union(by_transformer.select("model", F.col("home").alias("a"), "b")).where("a <> b").distinct()
        found = components_by_model(edges)
        least = found.groupBy("model", "component").agg(F.min_by("id", strip_underscore(F.col("id"))).alias("representative"))
        return bucketed(found.join(least, ["model", "component"]).select("model", "id", "representative"), "substation-merge", "model", "id")

    @cached_property
    def reachable_busbar(self) -> DataFrame:
        """(model, cn, bbs): the first busbar section, by node order, that any chain of switches reaches; also without switches."""
        parts = components_by_model(self.switch_ends.select("model", F.col("cn1").alias("a"), F.col("cn2").alias("b")).where("a <> b")).withColumnRenamed("id", "cn")
        nodes = self.containers.select("model", "cn", "cn_pos").join(parts, ["model", "cn"], "left").withColumn("component", F.coalesce("component", "cn"))
        held = nodes.join(self.busbars, ["model", "cn"]).groupBy("model", "component").agg(F.min_by("bbs", "cn_pos").alias("bbs"))
        return nodes.join(held, ["model", "component"]).select("model", "cn", "bbs")

    @cached_property
    def limit_types(self) -> DataFrame:
        """(model, type_id, infinite, direction)."""
        rows = self.grid.view(["OperationalLimitType"], {"infinite": "OperationalLimitType.isInfiniteDuration"}, {"direction": "OperationalLimitType.direction"})
        return rows.select("model", F.col("id").alias("type_id"), is_true(F.col("infinite")).alias("infinite"), "direction")

    @cached_property
    def limit_sets(self) -> DataFrame:
        """(model, set_id, set_pos, terminal, mrid, name)."""
        rows = self.grid.named(["OperationalLimitSet"], {}, {"terminal": "OperationalLimitSet.Terminal"})
        return rows.where("terminal IS NOT NULL").select("model", F.col("id").alias("set_id"), F.col("doc_pos").alias("set_pos"), "terminal", "mrid", F.coalesce("name", "mrid").alias("name"))

    @cached_property
    def limit_groups(self) -> DataFrame:
        """(model, terminal, set_pos, id, name, patl_text, patl, patl_mrid): the last unlimited current limit of each set."""
        limits = self.grid.named(
            ["CurrentLimit"], {"value": "CurrentLimit.value", "normal": "CurrentLimit.normalValue"}, {"set_id": "OperationalLimit.OperationalLimitSet", "type_id": "OperationalLimit.OperationalLimitType"}
        )
        unlimited = limits.join(self.limit_types.where("infinite"), ["model", "type_id"])
        last = unlimited.groupBy("model", "set_id").agg(F.max_by(F.struct(trimmed(F.coalesce("value", "normal")).alias("text"), F.col("mrid").alias("mrid")), "doc_pos").alias("patl"))
        rows = self.limit_sets.join(last, ["model", "set_id"], "left")
        return rows.select("model", "terminal", "set_pos", F.col("mrid").alias("id"), "name", F.col("patl.text").alias("patl_text"), number(F.col("patl.text")).alias("patl"), F.col("patl.mrid").alias("patl_mrid"))

    @cached_property
    def voltage_limits(self) -> DataFrame:
        """(model, vl, low, high) by the level of the limit's terminal, unmerged; what doesn't end in ``high`` is low; the last wins."""
        limits = self.grid.view(["VoltageLimit"], {"value": "VoltageLimit.normalValue"}, {"set_id": "OperationalLimit.OperationalLimitSet", "type_id": "OperationalLimit.OperationalLimitType"})
        rows = limits.join(self.limit_types, ["model", "type_id"]).where("direction IS NOT NULL").join(self.limit_sets.select("model", "set_id", "terminal"), ["model", "set_id"])
        ends = self.terminal_rows.select("model", F.col("id").alias("terminal"), "cn").where("cn IS NOT NULL")
        sited = self._in(rows.join(ends, ["model", "terminal"]), "cn", "vl").withColumn("value", number(F.col("value"))).where("value IS NOT NULL")
        sited = sited.join(self.grid.of_type("VoltageLevel").select("model", F.col("id").alias("vl")), ["model", "vl"], "left_semi")
        last = lambda high: F.max_by("value", "doc_pos") if high is None else F.expr(f"max_by(value, doc_pos) FILTER (WHERE {'' if high else 'NOT '}endswith(direction, 'high'))")
        return sited.groupBy("model", "vl").agg(last(False).alias("low"), last(True).alias("high"))

    @cached_property
    def curve_points(self) -> DataFrame:
        """(model, curve, points): p, min_q, max_q in document order; missing values are 0."""
        rows = self.grid.view(["CurveData"], {"p": "CurveData.xvalue", "a": "CurveData.y1value", "b": "CurveData.y2value"}, {"curve": "CurveData.Curve"})
        rows = self._mandatory(rows, "curve", "CurveData.Curve")
        value = lambda c: F.coalesce(number(F.col(c)), F.lit(0.0))
        point = F.struct("doc_pos", value("p").alias("p"), value("a").alias("min_q"), value("b").alias("max_q"))
        return rows.groupBy("model", "curve").agg(F.array_sort(F.collect_list(point)).alias("points"))

    @cached_property
    def levels(self) -> DataFrame:
        """(model, vl, representative, vl_mrid, home): every level with its surviving level and that one's substation, unmerged."""
        named = self.grid.named(["VoltageLevel"], {}, {"home": "VoltageLevel.Substation"})
        all_levels = named.select("model", F.col("id").alias("vl")).join(self.vl_merge.withColumnRenamed("id", "vl"), ["model", "vl"], "left")
        all_levels = all_levels.withColumn("representative", F.coalesce("representative", "vl"))
        sites = self.grid.of_type("Substation").select("model", F.col("id").alias("home"))
        kept = named.select("model", F.col("id").alias("representative"), F.col("mrid").alias("vl_mrid"), "home").join(sites, ["model", "home"])
        return bucketed(all_levels.join(kept, ["model", "representative"]), "levels", "model", "vl")

    @cached_property
    def level_sites(self) -> DataFrame:
        """(model, vl, substation): surviving levels with their merged substation."""
        kept = self.levels.where("vl = representative").select("model", "vl", "home")
        merged = self.substation_merge.select("model", F.col("id").alias("home"), "representative")
        return kept.join(merged, ["model", "home"], "left").select("model", "vl", F.coalesce("representative", "home").alias("substation"))

    @cached_property
    def level_nodes(self) -> DataFrame:
        """(model, cn, cn_pos, vl, vl_mrid): nodes with their surviving level."""
        return self.containers.join(self.levels.select("model", F.col("vl").alias("container"), F.col("representative").alias("vl"), "vl_mrid"), ["model", "container"])

    @cached_property
    def nodes(self) -> DataFrame:
        """(model, cn, cn_pos, vl, vl_mrid, base, size): nodes with their surviving level, numbered in document order within it."""
        own = Window.partitionBy("model", "vl")
        return self.level_nodes.select("model", "cn", "cn_pos", "vl", "vl_mrid", (F.row_number().over(own.orderBy("cn_pos")) - 1).alias("base"), F.count(F.lit(1)).over(own).cast("int").alias("size"))

    @cached_property
    def numbered(self) -> DataFrame:
        """(model, terminal, cn, vl, vl_mrid, base, node, dedicated, eq_type): the node of every terminal that has one.

        Busbar sections and switches sit on their node. Others, ranked by class, document order and sequence, get a
        node of their own if theirs has a busbar section or three or more of them, or is taken by an earlier one; such
        nodes are numbered behind the level's own, and each brings an internal connection.
        """
        return stored(node_numbers(self.terminal_rows, self.nodes, self.busbars), "node-map")

    @property
    def node_map(self) -> DataFrame:
        """(model, terminal, cn, vl, node, dedicated)."""
        return self.numbered.select("model", "terminal", "cn", "vl", "node", "dedicated")

    @cached_property
    def internal_connections(self) -> DataFrame:
        """(model, vl, nth, node1, node2), in order of rank."""
        own = Window.partitionBy("model", "vl").orderBy("node")
        return self.numbered.where("dedicated").select("model", "vl", F.row_number().over(own).alias("nth"), F.col("base").alias("node1"), F.col("node").alias("node2"))

    def places(self, *types: str) -> DataFrame:
        """(model, terminal, vl, vl_mrid, node) of terminals, of all or of those of equipment of classes.

        Busbar sections and switches have the number of their node, which needs no ranks of others.
        """
        columns = ["model", "terminal", "vl", "vl_mrid", "node"]
        if types and {*types} <= {BUSBAR, *SWITCHES} and "numbered" not in self.__dict__:
            rows = self.terminal_rows.where(F.col("eq_type").isin(*types) & F.col("cn").isNotNull()).select("model", "cn", F.col("id").alias("terminal"))
            return rows.join(self.nodes.withColumn("node", F.col("base").cast("int")), ["model", "cn"]).select(*columns)
        return (self.numbered.where(F.col("eq_type").isin(*types)) if types else self.numbered).select(*columns)

    def equipment_places(self, *types: str) -> DataFrame:
        """(model, id, terminal, vl, vl_mrid, node) of equipment of classes, by its first terminal."""
        first = self.terminals_of(*types).where("nth = 1").select("model", F.col("equipment").alias("id"), F.col("id").alias("terminal"))
        return first.join(self.places(*types), ["model", "terminal"])

    def sited(self, *types: str) -> DataFrame:
        """(model, id) of equipment of classes that are numbered or fixed whose first terminal is on a node of a level: that of equipment_places(), without the numbers."""
        first = self.terminals_of(*types).where("nth = 1 AND cn IS NOT NULL").select("model", "cn", F.col("equipment").alias("id"))
        return first.join(self.level_nodes.select("model", "cn"), ["model", "cn"], "left_semi").select("model", "id")


def node_numbers(terminals: DataFrame, nodes: DataFrame, busbars: DataFrame) -> DataFrame:
    """numbered from (model, id, doc_pos, cn, seq, eq_type, eq_pos), (model, cn, vl, vl_mrid, base, size) and (model, cn, bbs)."""
    fixed = F.col("eq_type").isin(BUSBAR, *SWITCHES)
    rows = terminals.where("cn IS NOT NULL").drop("equipment").join(nodes.select("model", "cn", "vl", "vl_mrid", F.col("base").cast("int").alias("base"), "size"), ["model", "cn"])
    on_node = Window.partitionBy("model", "cn")
    others = F.count_if(~F.coalesce(fixed, F.lit(False))).over(on_node)
    rows = rows.join(busbars.select("model", "cn", F.lit(True).alias("has_bbs")), ["model", "cn"], "left").withColumn("others", others)
    rank = F.struct(class_rank(F.col("eq_type"), NUMBERED).alias("class"), "eq_pos", "seq", "doc_pos")
    ranked = rows.withColumn("rank", rank).where(fixed | F.col("rank.class").isNotNull())
    taken = F.row_number().over(Window.partitionBy("model", "cn", fixed).orderBy("rank")) > 1
    ranked = ranked.withColumn("dedicated", ~fixed & (F.coalesce("has_bbs", F.lit(False)) | (F.col("others") >= 3) | taken))
    extra = F.row_number().over(Window.partitionBy("model", "vl", "dedicated").orderBy("rank"))
    node = F.when(F.col("dedicated"), F.col("size") + extra - 1).otherwise(F.col("base")).cast("int")
    return ranked.select("model", F.col("id").alias("terminal"), "cn", "vl", "vl_mrid", "base", node.alias("node"), "dedicated", "eq_type")
