"""The conversion: one DataFrame per element type of the network, from a Grid and its Index."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweft.functions.scalars import decode_entities, energy_source, enum_fragment, float_text, is_true, iso_seconds, number, strip_underscore, switch_kind, whole
from gridweft.operators.access import Grid
from gridweft.operators.sieve import sieved
from gridweft.plans.index import BUSBAR, LINES, LOADS, NUMBERED, SWITCHES, Index, class_rank
from gridweft.storage import stored

KEY = ["model", "id"]
UNITS = ["HydroGeneratingUnit", "NuclearGeneratingUnit", "SolarGeneratingUnit", "ThermalGeneratingUnit", "WindGeneratingUnit", "GeneratingUnit"]
LARGEST_DOUBLE = 1.7976931348623157e308
#: Labels of the summary, in order.
METRICS = ["Substations", "VoltageLevels", "BusbarSections", "Switches", "Loads", "Shunts", "StaticVarCompensators", "Generators", "2-winding transformers", "3-winding transformers", "Lines"]


def _or(c: str, other: float) -> Column:
    return F.coalesce(number(F.col(c)), F.lit(other))


def _pairs(*pairs: tuple[str, Column]) -> Column:
    """An array of (name, value) without null values, in order."""
    return F.filter(F.array(*[F.struct(F.lit(n).alias("name"), v.cast("string").alias("value")) for n, v in pairs]), lambda p: p["value"].isNotNull())


class Conversion:
    """Element tables of the networks of a Grid."""

    def __init__(self, grid: Grid, strict: bool = False, index: Index | None = None):
        self.grid, self.index = grid, index or Index(grid, strict)

    def _placed(self, rows: DataFrame, *types: str) -> DataFrame:
        return rows.join(self.index.equipment_places(*types), KEY)

    @cached_property
    def full_models(self) -> DataFrame:
        """FullModels with their number in document order, from 1."""
        rows = self.grid.view(
            ["FullModel"],
            {"scenario": "Model.scenarioTime", "created": "Model.created", "authority": "Model.modelingAuthoritySet", "description": "Model.description", "version": "Model.version"},
        )
        return rows.withColumn("nth", F.row_number().over(Window.partitionBy("model").orderBy("doc_pos")))

    def network(self) -> DataFrame:
        """(model, id, case_date, forecast_distance): the first FullModel; minutes from creation to scenario, not below 0."""
        models = self.grid.objects.select("model").distinct()
        minutes = F.floor((iso_seconds(F.col("scenario")) - iso_seconds(F.col("created"))) / 60)
        first = self.full_models.where("nth = 1").select("model", "id", "scenario", F.coalesce(F.greatest(minutes, F.lit(0)), F.lit(0)).cast("long").alias("distance"))
        out = models.join(first, "model", "left")
        return out.select("model", F.coalesce("id", F.lit("unknown")).alias("id"), F.col("scenario").alias("case_date"), F.coalesce("distance", F.lit(0)).cast("long").alias("forecast_distance"))

    def substations(self) -> DataFrame:
        """Substations that are not merged away, with region names and aliases of those merged into them."""
        rows = self.grid.named(["Substation"], {}, {"region": "Substation.Region"})
        regions = self.grid.named(["SubGeographicalRegion"], {}, {"country": "SubGeographicalRegion.Region"}).select("model", F.col("id").alias("region"), F.col("name").alias("geo_tag"), "country")
        countries = self.grid.named(["GeographicalRegion"]).select("model", F.col("id").alias("country"), F.col("name").alias("country_name"))
        merged = self.index.substation_merge
        kept = rows.join(merged.where("id <> representative").select(*KEY), KEY, "left_anti")
        out = kept.join(regions, ["model", "region"], "left").join(countries, ["model", "country"], "left").join(self._aliases(rows, merged, "MergedSubstation"), KEY, "left")
        return out.select("model", "id", "doc_pos", "mrid", "name", F.col("country_name").alias("country"), "geo_tag", "aliases")

    def _aliases(self, rows: DataFrame, merged: DataFrame, label: str) -> DataFrame:
        """Numbered aliases of representatives, by the document order of what they absorbed."""
        stubs = merged.where("id <> representative").join(rows.select("model", "id", "doc_pos", "mrid"), KEY)
        listed = F.array_sort(F.collect_list(F.struct("doc_pos", "mrid")))
        numbered = F.transform(listed, lambda x, i: F.struct(F.concat(F.lit(label), (i + 1).cast("string")).alias("type"), x["mrid"].alias("content")))
        return stubs.groupBy("model", F.col("representative").alias("id")).agg(numbered.alias("aliases"))

    def voltage_levels(self) -> DataFrame:
        """Levels that survive merging, under their merged substation, with the limits of their own id."""
        rows = self.grid.named(["VoltageLevel"], {}, {"base": "VoltageLevel.BaseVoltage"})
        nominal = self.grid.view(["BaseVoltage"], {"nominal": "BaseVoltage.nominalVoltage"}).select("model", F.col("id").alias("base"), number(F.col("nominal")).alias("nominal_v"))
        kept = self.index.level_sites.select("model", F.col("vl").alias("id"), "substation")
        limits = self.index.voltage_limits.select("model", F.col("vl").alias("id"), "low", "high")
        out = rows.join(kept, KEY).join(nominal, ["model", "base"], "left").join(limits, KEY, "left").join(self._aliases(rows, self.index.vl_merge, "MergedVoltageLevel"), KEY, "left")
        return out.select("model", "id", "doc_pos", "mrid", "name", "substation", "nominal_v", "low", "high", "aliases")

    def busbars(self) -> DataFrame:
        return self._placed(self.grid.named([BUSBAR]), BUSBAR).select("model", "vl", "doc_pos", "mrid", "name", "node")

    def switches(self) -> DataFrame:
        """Switches with two terminals or more, in the level of the first; class order, then document order."""
        rows = self.grid.named(SWITCHES, {"open": "Switch.open", "retained": "Switch.retained"})
        node = lambda k: self.index.terminals_of(*SWITCHES).where(f"nth = {k}").select("model", F.col("equipment").alias("id"), F.col("id").alias("terminal")).join(self.index.places(*SWITCHES), ["model", "terminal"])
        first = node(1).select(*KEY, "vl", F.col("node").alias("node1"))
        second = node(2).select(*KEY, F.col("node").alias("node2"))
        return rows.join(first, KEY).join(second, KEY).select(
            "model", "vl", class_rank(F.col("type"), SWITCHES).alias("class_rank"), "doc_pos", "mrid", "name", switch_kind(F.col("type")).alias("kind"), is_true(F.col("retained")).alias("retained"), is_true(F.col("open")).alias("open"), "node1", "node2"
        )

    def loads(self) -> DataFrame:
        rows = self._placed(self.grid.named(LOADS, {}, {"response": "EnergyConsumer.LoadResponse"}), *LOADS)
        prefix = "LoadResponseCharacteristic."
        fields = {"exponential": "exponentModel", "np": "pVoltageExponent", "nq": "qVoltageExponent", "c0p": "pConstantPower", "c1p": "pConstantCurrent", "c2p": "pConstantImpedance", "c0q": "qConstantPower", "c1q": "qConstantCurrent", "c2q": "qConstantImpedance"}
        models = self.grid.view(["LoadResponseCharacteristic"], {k: prefix + v for k, v in fields.items()}).withColumnRenamed("id", "response").drop("doc_pos", "type")
        out = rows.join(models.withColumn("known", F.lit(True)), ["model", "response"], "left")
        exponential = is_true(F.col("exponential"))
        of = lambda names: F.struct(*[_or(n, 0.0).alias(n) for n in names])
        return out.select(
            "model", "vl", class_rank(F.col("type"), LOADS).alias("class_rank"), "doc_pos", "mrid", "name", "node", F.col("type").alias("original_class"), strip_underscore(F.col("terminal")).alias("terminal1"),
            F.when(F.col("known") & exponential, of(["np", "nq"])).alias("exponential_model"),
            F.when(F.col("known") & ~exponential, of(["c0p", "c1p", "c2p", "c0q", "c1q", "c2q"])).alias("zip_model"),
        )

    def shunts(self) -> DataFrame:
        rows = self.grid.named(
            ["LinearShuntCompensator"],
            {"sections": "ShuntCompensator.sections", "most": "ShuntCompensator.maximumSections", "b": "LinearShuntCompensator.bPerSection", "g": "LinearShuntCompensator.gPerSection", "control": "RegulatingCondEq.controlEnabled"},
        )
        count = lambda c: F.coalesce(whole(F.col(c), "long"), F.lit(0)).cast("long")
        return self._placed(rows, "LinearShuntCompensator").select("model", "vl", "doc_pos", "mrid", "name", "node", count("sections").alias("sections"), count("most").alias("max_sections"), _or("b", 0.0).alias("b"), _or("g", 0.0).alias("g"), is_true(F.col("control")).alias("regulating"))

    def svcs(self) -> DataFrame:
        rows = self.grid.named(["StaticVarCompensator"], {"b_min": "StaticVarCompensator.bMin", "b_max": "StaticVarCompensator.bMax", "control": "RegulatingCondEq.controlEnabled"}, {"mode": "StaticVarCompensator.regulationMode"})
        mode = F.when(F.col("mode").endswith("voltage"), "VOLTAGE").when(F.col("mode").endswith("reactivePower"), "REACTIVE_POWER").otherwise("OFF")
        return self._placed(rows, "StaticVarCompensator").select("model", "vl", "doc_pos", "mrid", "name", "node", _or("b_min", 0.0).alias("b_min"), _or("b_max", 0.0).alias("b_max"), mode.alias("mode"), is_true(F.col("control")).alias("regulating"))

    def generators(self) -> DataFrame:
        rows = self.grid.named(
            ["SynchronousMachine"],
            {"rated_s": "RotatingMachine.ratedS", "control": "RegulatingCondEq.controlEnabled", "min_q": "SynchronousMachine.minQ", "max_q": "SynchronousMachine.maxQ"},
            {"kind": "SynchronousMachine.type", "unit": "RotatingMachine.GeneratingUnit", "curve": "SynchronousMachine.InitialReactiveCapabilityCurve", "control_ref": "RegulatingCondEq.RegulatingControl"},
        )
        unit_source = self.grid.objects.join(rows.select("model", F.col("unit").alias("id")).distinct(), KEY, "left_semi")
        units = self.grid.view(None, {"min_p": "GeneratingUnit.minOperatingP", "max_p": "GeneratingUnit.maxOperatingP", "unit_mrid": "IdentifiedObject.mRID"}, {"wind": "WindGeneratingUnit.windGenUnitType"}, unit_source)
        units = units.select("model", F.col("id").alias("unit"), F.col("type").alias("unit_type"), "min_p", "max_p", F.coalesce("unit_mrid", strip_underscore(F.col("id"))).alias("unit_mrid"), F.when(F.col("type") == "WindGeneratingUnit", enum_fragment(F.col("wind"))).alias("wind"))
        fuels = self.grid.view(["FossilFuel"], {}, {"unit": "FossilFuel.ThermalGeneratingUnit", "fuel": "FossilFuel.fossilFuelType"}).where("fuel RLIKE '#[^#]*[.][^#]*$'")
        fuels = fuels.groupBy("model", "unit").agg(F.max_by(enum_fragment(F.col("fuel")), "doc_pos").alias("fuel"))
        controls = self.grid.view(["RegulatingControl"], {"control_mrid": "IdentifiedObject.mRID"}, {"mode": "RegulatingControl.mode", "control_terminal": "RegulatingControl.Terminal"})
        controls = controls.select("model", F.col("id").alias("control_ref"), F.coalesce("control_mrid", strip_underscore(F.col("id"))).alias("control_mrid"), F.lower("mode").alias("mode"), "control_terminal")
        ends = self.index.terminal_rows.select("model", F.col("id").alias("control_terminal"), F.col("equipment").alias("regulated"), F.col("cn").alias("regulated_cn"))
        reach = self.index.reachable_busbar.select("model", F.col("cn").alias("regulated_cn"), "bbs")
        curves = self.index.curve_points.select("model", "curve", "points")
        out = self._placed(rows, "SynchronousMachine")
        for other, key in ((units, "unit"), (fuels, "unit"), (controls, "control_ref"), (ends, "control_terminal"), (reach, "regulated_cn"), (curves, "curve")):
            out = out.join(other, ["model", key], "left")
        limits = F.struct(number(F.col("min_q")).alias("min_q"), number(F.col("max_q")).alias("max_q"))
        both = F.col("points").isNull() & number(F.col("min_q")).isNotNull() & number(F.col("max_q")).isNotNull()
        kind = F.coalesce("kind", F.lit(""))
        return out.select(
            "model", "vl", "doc_pos", "mrid", "name", "node", energy_source(F.coalesce("unit_type", F.lit(""))).alias("energy_source"), number(F.col("min_p")).alias("min_p"), number(F.col("max_p")).alias("max_p"), number(F.col("rated_s")).alias("rated_s"),
            is_true(F.col("control")).alias("regulating"), kind.contains("ondenser").alias("condenser"), F.when(~F.col("regulated").eqNullSafe(F.col("id")), F.col("bbs")).alias("regulating_terminal"), "points", F.when(both, limits).alias("limits"), strip_underscore(F.col("terminal")).alias("terminal1"),
            _pairs(("CGMES.fuelType", F.col("fuel")), ("CGMES.synchronousMachineType", enum_fragment(F.col("kind"), "null")), ("CGMES.mode", F.col("mode")), ("CGMES.originalClass", F.lit("SynchronousMachine")), ("CGMES.GeneratingUnit", F.col("unit_mrid")), ("CGMES.RegulatingControl", F.col("control_mrid")), ("CGMES.windGenUnitType", F.col("wind"))).alias("properties"),
        )

    @cached_property
    def transformer_ends(self) -> DataFrame:
        """Ends of transformers in order of their numbers; a missing number is 0."""
        end = "PowerTransformerEnd."
        rows = self.grid.view(["PowerTransformerEnd"], {"rated_u": end + "ratedU", "r": end + "r", "x": end + "x", "g": end + "g", "b": end + "b", "rated_s": end + "ratedS", "number": "TransformerEnd.endNumber"}, {"transformer": end + "PowerTransformer", "terminal": "TransformerEnd.Terminal"})
        own = Window.partitionBy("model", "transformer")
        order = F.coalesce(whole(F.col("number")), F.lit(0))
        ranked = rows.where("transformer IS NOT NULL").withColumns({"nth": F.row_number().over(own.orderBy(order, "doc_pos")), "n": F.count(F.lit(1)).over(own)})
        ranked = stored(ranked.drop("doc_pos", "type", "number"), "end-rows")
        places = sieved(self.index.places(), ranked.where("terminal IS NOT NULL"), ["model", "terminal"], ranked.count())
        return stored(ranked.join(places, ["model", "terminal"], "left").select("model", "transformer", F.col("id").alias("end"), "nth", "n", "vl", "vl_mrid", "node", number(F.col("rated_u")).alias("rated_u"), *[_or(c, 0.0).alias(c) for c in "rxgb"], number(F.col("rated_s")).alias("rated_s")), "ends")

    def _steps(self, points: str, table: str, angle: str | None) -> DataFrame:
        """(model, table, steps) in document order; rho is 1 over the ratio, points without a ratio are left out."""
        p = "TapChangerTablePoint."
        rows = self.grid.view([points], {k: p + k for k in ("r", "x", "g", "b", "ratio")} | ({"angle": angle} if angle else {}), {"table": table}).where("table IS NOT NULL")
        ratio = number(F.col("ratio"))
        step = [_or(c, 0.0).alias(c) for c in "rxgb"] + [F.when(ratio == 0, 1.0).otherwise(1 / F.nullif(ratio, F.lit(0.0))).alias("rho"), (_or("angle", 0.0) if angle else F.lit(None).cast("double")).alias("alpha")]
        return rows.where(ratio.isNotNull()).groupBy("model", "table").agg(F.array_sort(F.collect_list(F.struct("doc_pos", *step))).alias("steps"))

    @cached_property
    def tap_changers(self) -> DataFrame:
        """(model, end, phase, low, position, ltc, steps): the last usable ratio and phase tap changer of every end."""
        t = "TapChanger."
        common = {"low": t + "lowStep", "high": t + "highStep", "neutral": t + "neutralStep", "normal": t + "normalStep", "ltc": t + "ltcFlag", "increment": "RatioTapChanger.stepVoltageIncrement"}
        step = F.struct(F.lit(0).cast("long").alias("doc_pos"), *[F.lit(0.0).alias(c) for c in "rxgb"], F.lit(1.0).alias("rho"), F.lit(None).cast("double").alias("alpha"))
        found = None
        for kind, prefix, phase in (("RatioTapChanger", "RatioTapChanger", False), ("PhaseTapChangerTabular", "PhaseTapChanger", True)):
            table = "PhaseTapChangerTable" if phase else "RatioTapChangerTable"
            rows = self.grid.view([kind], common, {"end": prefix + ".TransformerEnd", "table": f"{prefix}.{table}"})
            rows = rows.withColumns({c: whole(F.col(c)) for c in ("low", "high", "neutral", "normal")} | {"increment": number(F.col("increment"))})
            steps = self._steps(table + "Point", f"{table}Point.{table}", "PhaseTapChangerTablePoint.angle" if phase else None)
            rows = rows.where("end IS NOT NULL AND low IS NOT NULL AND normal IS NOT NULL AND ltc IS NOT NULL").join(steps, ["model", "table"], "left")
            rho = lambda s: 1 + (s - F.col("neutral")) * F.col("increment") / 100
            linear = F.when(
                F.col("table").isNull() & F.col("increment").isNotNull() & (F.col("high") >= F.col("low")) & F.col("neutral").isNotNull(),
                F.transform(F.sequence("low", "high"), lambda s: F.struct(s.cast("long").alias("doc_pos"), *[F.lit(0.0).alias(c) for c in "rxgb"], rho(s).alias("rho"), F.lit(None).cast("double").alias("alpha"))),
            )
            rows = rows.withColumn("steps", F.col("steps") if phase else F.coalesce("steps", linear)).where("steps IS NOT NULL")
            last = rows.groupBy("model", "end").agg(F.max_by(F.struct("low", F.col("normal").alias("position"), is_true(F.col("ltc")).alias("ltc"), "steps"), "doc_pos").alias("t"))
            one = last.select("model", "end", F.lit(phase).alias("phase"), "t.*")
            found = one if found is None else found.unionByName(one)
        return stored(found, "tap-changers")

    def _by_end(self, n: int) -> DataFrame:
        """Transformers with exactly n usable ends: columns e1..en."""
        fields = F.struct("end", "vl", "vl_mrid", "node", "rated_u", "r", "x", "g", "b", "rated_s")
        rows = self.transformer_ends.where(f"n = {n}").groupBy("model", F.col("transformer").alias("id")).agg(*[F.max(F.when(F.col("nth") == k, fields)).alias(f"e{k}") for k in range(1, n + 1)])
        for k in range(1, n + 1):
            rows = rows.where(f"e{k}.node IS NOT NULL AND e{k}.rated_u IS NOT NULL")
        return self.grid.named(["PowerTransformer"]).join(rows, KEY).withColumn("vl", F.col("e1.vl")).join(self.index.level_sites, ["model", "vl"])

    def _tap(self, rows: DataFrame, phase: bool, out: str, end: str) -> DataFrame:
        taps = self.tap_changers.where(F.col("phase") == phase).select("model", F.col("end").alias("_end"), F.struct("low", "position", "ltc", "steps").alias(out))
        return rows.withColumn("_end", F.col(end)).join(taps, ["model", "_end"], "left").drop("_end")

    def two_windings(self) -> DataFrame:
        """Impedances of end 1 on side 2; the tap changer of end 1, else of end 2."""
        rows = self._by_end(2)
        for phase, name in ((False, "ratio"), (True, "phase")):
            for k in (1, 2):
                rows = self._tap(rows, phase, f"{name}{k}", f"e{k}.end")
        ratio2 = (F.col("e2.rated_u") / F.col("e1.rated_u")) * (F.col("e2.rated_u") / F.col("e1.rated_u"))
        return rows.select(
            "model", "substation", "doc_pos", "mrid", "name", (F.col("e1.r") * ratio2).alias("r"), (F.col("e1.x") * ratio2).alias("x"), (F.col("e1.g") / ratio2).alias("g"), (F.col("e1.b") / ratio2).alias("b"), F.col("e1.rated_u").alias("rated_u1"), F.col("e2.rated_u").alias("rated_u2"), F.col("e1.rated_s").alias("rated_s"),
            F.col("e1.vl_mrid").alias("vl1"), F.col("e1.node").alias("node1"), F.col("e2.vl_mrid").alias("vl2"), F.col("e2.node").alias("node2"), F.coalesce("ratio1", "ratio2").alias("ratio_tap_changer"), F.coalesce("phase1", "phase2").alias("phase_tap_changer"),
        )

    def three_windings(self) -> DataFrame:
        """Legs as they are; the common voltage is that of end 1."""
        rows = self._by_end(3)
        for k in (1, 2, 3):
            rows = self._tap(rows, False, f"ratio{k}", f"e{k}.end")
        return rows.select("model", "substation", "doc_pos", "mrid", "name", F.col("e1.rated_u").alias("rated_u0"), "e1", "e2", "e3", "ratio1", "ratio2", "ratio3")

    @cached_property
    def boundary_terminals(self) -> DataFrame:
        """Terminals of lines and series compensators on nodes outside all levels, numbered from 1 within the node."""
        ends = self.index.terminal_rows.where(F.col("eq_type").isin(*LINES) & F.col("cn").isNotNull())
        outside = self.index.containers.join(self.index.levels.select("model", F.col("vl").alias("container")), ["model", "container"], "left_anti")
        rank = F.struct(class_rank(F.col("eq_type"), LINES), "eq_pos", "seq", "doc_pos")
        nth = F.row_number().over(Window.partitionBy("model", "cn").orderBy(rank))
        return ends.join(outside, ["model", "cn"]).select("model", "cn", "cn_pos", "container", F.col("id").alias("terminal"), "equipment", nth.alias("node"))

    @cached_property
    def fictitious_levels(self) -> DataFrame:
        """(model, cn, cn_pos, id, name, nominal_v, container, terminals): one level per boundary node; hub 0 and a node per terminal."""
        first = self.boundary_terminals.groupBy("model", "cn", "cn_pos", "container").agg(F.min_by("equipment", "node").alias("segment"), F.max("node").alias("terminals"))
        nodes = self.grid.view(["ConnectivityNode"], {"cn_mrid": "IdentifiedObject.mRID"}).select("model", F.col("id").alias("cn"), F.coalesce("cn_mrid", strip_underscore(F.col("id"))).alias("cn_mrid"))
        boxes = self.grid.objects.join(first.select("model", F.col("container").alias("id")).distinct(), KEY, "left_semi")
        boxes = self.grid.view(None, {"box_mrid": "IdentifiedObject.mRID", "box_name": "IdentifiedObject.name"}, {}, boxes).select("model", F.col("id").alias("container"), "box_mrid", "box_name")
        segments = self.grid.view(["ACLineSegment", "SeriesCompensator"], {}, {"base": "ConductingEquipment.BaseVoltage"}).select("model", F.col("id").alias("segment"), "base")
        nominal = self.grid.view(["BaseVoltage"], {"v": "BaseVoltage.nominalVoltage"}).select("model", F.col("id").alias("base"), number(F.col("v")).alias("nominal_v"))
        out = first.join(nodes, ["model", "cn"]).join(boxes, ["model", "container"], "left").join(segments, ["model", "segment"], "left").join(nominal, ["model", "base"], "left")
        return stored(out.select("model", "cn", "cn_pos", F.concat("cn_mrid", F.lit("_VL")).alias("id"), F.col("box_name").alias("name"), "nominal_v", F.coalesce("box_mrid", strip_underscore(F.col("container"))).alias("container"), "terminals"), "fictitious")

    def boundary_generators(self) -> DataFrame:
        """Equivalent injections at the hub of a fictitious level; elsewhere there are none."""
        rows = self.grid.named(["EquivalentInjection"])
        ends = self.index.terminals_of("EquivalentInjection").where("nth = 1").select("model", F.col("equipment").alias("id"), "cn", F.col("id").alias("terminal"))
        levels = self.fictitious_levels.select("model", "cn", F.col("id").alias("vl"))
        out = rows.join(ends, KEY).join(levels, ["model", "cn"])
        return out.select("model", "vl", "doc_pos", "mrid", F.lit("BoundaryInjectionEq").alias("name"), F.lit(0).alias("node"), F.lit(-LARGEST_DOUBLE).alias("min_p"), F.lit(LARGEST_DOUBLE).alias("max_p"), strip_underscore(F.col("terminal")).alias("terminal1"))

    def line_places(self, *types: str) -> DataFrame:
        """(model, terminal, vl_mrid, node): in a level, else in a fictitious one; of all terminals, or of those of line classes."""
        fictitious = self.boundary_terminals.join(self.fictitious_levels.select("model", "cn", "id"), ["model", "cn"]).select("model", "terminal", F.col("id").alias("vl_mrid"), "node")
        regular = self.index.places(*types).select("model", "terminal", "vl_mrid", "node")
        # Boundary terminals are those of lines.
        held = self.index.places(*LINES).select("model", "terminal")
        return regular.unionByName(fictitious.join(held, ["model", "terminal"], "left_anti"))

    @cached_property
    def limit_lists(self) -> DataFrame:
        """(model, terminal, groups): limit groups of a terminal in document order."""
        properties = _pairs(("CGMES.normalValue_CurrentLimit_patl", float_text(F.col("patl_text"))), ("CGMES.OperationalLimitSetName", F.col("name")), ("CGMES.OperationalLimitSetRdfID", F.col("id")), ("CGMES.OperationalLimit_CurrentLimit_patl", F.col("patl_mrid")))
        group = F.struct("set_pos", "id", properties.alias("properties"), F.col("patl").alias("permanent"))
        return self.index.limit_groups.groupBy("model", "terminal").agg(F.array_sort(F.collect_list(group)).alias("groups"))

    def lines(self) -> DataFrame:
        """AC line segments and then series compensators with exactly two placed terminals; charging is halved."""
        a, s = "ACLineSegment.", "SeriesCompensator."
        segments = self.grid.named(["ACLineSegment"], {"r": a + "r", "x": a + "x", "gch": a + "gch", "bch": a + "bch"})
        series = self.grid.named(["SeriesCompensator"], {"r": s + "r", "x": s + "x"}).withColumns({"gch": F.lit(None).cast("string"), "bch": F.lit(None).cast("string")})
        rows = segments.unionByName(series)
        ends = self.index.terminals_of(*LINES).where("nth <= 2 AND n = 2").select("model", F.col("equipment").alias("id"), F.col("id").alias("terminal"), "nth", "doc_pos")
        ends = ends.join(self.line_places(*LINES), ["model", "terminal"]).join(self.limit_lists, ["model", "terminal"], "left")
        of = lambda k: F.expr(f"max_by(struct(terminal, vl_mrid, node, groups), doc_pos) FILTER (WHERE nth = {k})").alias(f"end{k}")
        both = ends.groupBy(*KEY).agg(of(1), of(2)).where("end1 IS NOT NULL AND end2 IS NOT NULL")
        out = [F.col(f"end{k}.{c}").alias(f"{a}{k}") for k in (1, 2) for c, a in (("terminal", "t"), ("vl_mrid", "vl"), ("node", "node"), ("groups", "groups"))]
        rows = rows.join(both.select(*KEY, *out), KEY)
        rank = class_rank(F.col("type"), ["ACLineSegment", "SeriesCompensator"])
        half = lambda c: (_or(c, 0.0) / 2)
        return rows.select(
            "model", rank.alias("class_rank"), "doc_pos", "mrid", "name", F.col("type").alias("original_class"), _or("r", 0.0).alias("r"), _or("x", 0.0).alias("x"), half("gch").alias("g1"), half("bch").alias("b1"), half("gch").alias("g2"), half("bch").alias("b2"),
            "vl1", "node1", "vl2", "node2", strip_underscore(F.col("t1")).alias("terminal1"), strip_underscore(F.col("t2")).alias("terminal2"), "groups1", "groups2",
        )

    def areas(self) -> DataFrame:
        """Control areas with their tie flows' terminals; a tie flow names its area by id or by mRID."""
        rows = self.grid.named(["ControlArea"], {}, {"kind": "ControlArea.type"})
        flows = self.grid.view(["TieFlow"], {}, {"area": "TieFlow.ControlArea", "terminal": "TieFlow.Terminal"}).select("model", "area", "terminal", F.col("doc_pos").alias("flow_pos"))
        keys = rows.select("model", F.col("id").alias("area_id"), F.explode(F.array_distinct(F.array("id", "mrid"))).alias("area"))
        ends = self.index.terminal_rows.select("model", F.col("id").alias("terminal"), "equipment", "seq")
        names = self.grid.named(None).select("model", F.col("id").alias("equipment"), F.col("mrid").alias("equipment_mrid"))
        tied = flows.join(keys, ["model", "area"]).join(ends, ["model", "terminal"]).join(names, ["model", "equipment"])
        side = F.when(F.col("seq") == 1, "ONE").otherwise("TWO")
        boundary = tied.groupBy("model", F.col("area_id").alias("id")).agg(F.array_sort(F.collect_set(F.struct("flow_pos", F.col("equipment_mrid").alias("id"), side.alias("side")))).alias("boundaries"))
        # Without a hash the text is taken as it is.
        kind = F.coalesce(F.substring_index("kind", "#", -1), F.lit("ControlAreaTypeKind.Interchange"))
        return rows.join(boundary, KEY, "left").select("model", "doc_pos", "mrid", F.coalesce("name", "mrid").alias("name"), kind.alias("area_type"), "boundaries")

    def tap_changer_extensions(self) -> DataFrame:
        """(model, transformer, rank, doc_pos, id, type, step): ratio before phase tap changers, in document order."""
        found = None
        ends = self.grid.view(["PowerTransformerEnd"], {}, {"transformer": "PowerTransformerEnd.PowerTransformer"}).select("model", F.col("id").alias("end"), "transformer")
        names = self.grid.named(["PowerTransformer"]).select("model", F.col("id").alias("transformer"), F.col("mrid").alias("transformer_mrid"))
        for rank, (kind, prefix) in enumerate((("RatioTapChanger", "RatioTapChanger"), ("PhaseTapChangerTabular", "PhaseTapChanger"))):
            rows = self.grid.named([kind], {"step": "TapChanger.normalStep"}, {"end": prefix + ".TransformerEnd"}).withColumn("step", whole(F.col("step"))).where("step IS NOT NULL")
            one = rows.join(ends, ["model", "end"]).join(names, ["model", "transformer"])
            one = one.select("model", F.col("transformer_mrid").alias("transformer"), F.lit(rank).alias("rank"), "doc_pos", F.col("mrid").alias("id"), F.lit(kind if rank else None).cast("string").alias("type"), "step")
            found = one if found is None else found.unionByName(one)
        return found

    def load_details(self) -> DataFrame:
        """(model, doc_pos, id) of the loads of loads(), whose numbers they don't need."""
        rows = self.grid.named(LOADS).join(self.index.sited(*LOADS), KEY, "left_semi")
        return rows.select("model", "doc_pos", F.col("mrid").alias("id"))

    def reactive_extensions(self) -> DataFrame:
        """(model, doc_pos, id, q_percent) of machines with a share."""
        rows = self.grid.named(["SynchronousMachine"], {"q": "SynchronousMachine.qPercent"})
        return rows.select("model", "doc_pos", F.col("mrid").alias("id"), number(F.col("q")).alias("q_percent")).where("q_percent IS NOT NULL")

    def metadata_models(self) -> DataFrame:
        """FullModels, the second and later ones before the first, with profiles and dependencies in document order."""
        parts = self.grid.named_tags({"Model.profile", "Model.DependentOn"})
        listed = lambda value, when: F.transform(F.array_sort(F.collect_list(F.when(when & value.isNotNull(), F.struct("pos", value.alias("v"))))), lambda x: x["v"])
        lists = parts.groupBy("model", F.col("subj_pos").alias("doc_pos")).agg(listed(F.col("text"), F.col("pred") == "Model.profile").alias("profiles"), listed(F.col("ref"), F.col("pred") == "Model.DependentOn").alias("dependent_on"))
        out = self.full_models.join(lists, ["model", "doc_pos"], "left")
        equipment = F.exists(F.coalesce("profiles", F.array().cast("array<string>")), lambda p: p.contains("CoreEquipment"))
        return out.select(
            "model", F.when(F.col("nth") == 1, F.lit(2**31 - 1)).otherwise(F.col("nth")).alias("nth"), "id", F.when(equipment, "EQUIPMENT").otherwise("UNKNOWN").alias("subset"), F.coalesce("authority", F.lit("")).alias("authority"),
            F.coalesce(decode_entities(F.col("description")), F.lit("")).alias("description"), F.coalesce(whole(F.col("version")), F.lit(0)).alias("version"), "profiles", "dependent_on",
        )

    def base_voltages(self) -> DataFrame:
        """(model, doc_pos, id, nominal_v, source): BOUNDARY behind the second FullModel, else IGM."""
        rows = self.grid.named(["BaseVoltage"], {"v": "BaseVoltage.nominalVoltage"}).withColumn("nominal_v", number(F.col("v"))).where("nominal_v IS NOT NULL")
        second = self.full_models.where("nth = 2").select("model", F.col("doc_pos").alias("border"))
        source = F.when(F.col("doc_pos") > F.col("border"), "BOUNDARY").otherwise("IGM")
        return rows.join(second, "model", "left").select("model", "doc_pos", F.col("mrid").alias("id"), "nominal_v", source.alias("source"))

    def _placed_counts(self) -> DataFrame:
        """(model, metric, n) of what terminals place: one pass over the terminals, without node numbers, names or values.

        Terminals meet the nodes that lie in a level, or outside all levels, once; a piece of equipment is counted for
        each object of its id, as busbars() and the others have a row for each, and as lines() has.
        """
        of = {BUSBAR: "BusbarSections", **dict.fromkeys(SWITCHES, "Switches"), **dict.fromkeys(LOADS, "Loads"), "LinearShuntCompensator": "Shunts", "StaticVarCompensator": "StaticVarCompensators", "SynchronousMachine": "Generators", **dict.fromkeys(LINES, "Lines")}
        metric = F.create_map(*[F.lit(x) for pair in of.items() for x in pair])[F.col("type")]
        rows = self.index.terminal_rows.where(F.col("eq_type").isin(*of)).select("model", "id", "equipment", F.col("eq_type").alias("type"), "seq", "doc_pos", "cn")
        levels = self.index.levels.select("model", F.col("vl").alias("container")).distinct().withColumn("inside", F.lit(True))
        nodes = self.index.containers.select("model", "cn", "container").join(levels, ["model", "container"], "left").select("model", "cn", F.coalesce("inside", F.lit(False)).alias("inside"))
        # Nodes outside all levels take the terminals of lines alone.
        at = F.when(F.col("inside"), True).when(F.col("inside").isNotNull(), F.col("type").isin(*LINES)).otherwise(False)
        placed = rows.join(nodes, ["model", "cn"], "left").select("model", F.col("equipment").alias("id"), "type", F.struct("seq", "doc_pos", at.alias("at")).alias("t"))
        ends = placed.groupBy(*KEY, "type").agg(F.slice(F.array_sort(F.collect_list("t")), 1, 2).alias("ends"), F.count(F.lit(1)).alias("n"))
        nth = lambda k: F.coalesce(F.get("ends", F.lit(k))["at"], F.lit(False))
        both = F.col("type").isin(*SWITCHES, *LINES)
        found = ends.where(nth(0) & (~both | nth(1)) & (~F.col("type").isin(*LINES) | (F.col("n") == 2)))
        objects = self.grid.of_type(*of).select(*KEY, "type")
        # The class of a terminal's equipment is that of the last object of its id; the objects counted are all of the metric.
        return objects.withColumn("metric", metric).join(found.select(*KEY, metric.alias("metric")), [*KEY, "metric"], "left_semi").groupBy("model", "metric").agg(F.count(F.lit(1)).alias("n"))

    def _transformer_counts(self) -> DataFrame:
        """(model, metric, n) of the transformers of two and of three ends, all with a voltage and a terminal on a node of a level."""
        end = "PowerTransformerEnd."
        ends = self.grid.view(["PowerTransformerEnd"], {"rated_u": end + "ratedU"}, {"transformer": end + "PowerTransformer", "terminal": "TransformerEnd.Terminal"}).where("transformer IS NOT NULL")
        ends = stored(ends.select("model", "transformer", "terminal", number(F.col("rated_u")).isNotNull().alias("rated")), "end-rows")
        wanted = ends.where("terminal IS NOT NULL")
        there = self.index.terminal_rows.where(F.col("eq_type").isin(BUSBAR, *SWITCHES, *NUMBERED) & F.col("cn").isNotNull()).select("model", F.col("id").alias("terminal"), "cn")
        there = sieved(there, wanted, ["model", "terminal"], wanted.count())
        placed = there.join(self.index.level_nodes.select("model", "cn"), ["model", "cn"], "left_semi").select("model", "terminal", F.lit(True).alias("placed"))
        usable = F.col("rated") & F.coalesce("placed", F.lit(False))
        each = ends.join(placed, ["model", "terminal"], "left").groupBy("model", F.col("transformer").alias("id")).agg(F.count(F.lit(1)).alias("ends"), F.bool_and(usable).alias("usable")).where("usable AND ends IN (2, 3)")
        metric = F.when(F.col("ends") == 2, METRICS[8]).otherwise(METRICS[9])
        return self.grid.of_type("PowerTransformer").select(*KEY).join(each, KEY).groupBy("model", metric.alias("metric")).agg(F.count(F.lit(1)).alias("n"))

    def totals(self) -> DataFrame:
        """(model, nth, metric, n): the eleven counts of a conversion in their order, 0 where a model has no such element."""
        count = lambda rows, metric: rows.groupBy("model").agg(F.count(F.lit(1)).alias("n")).select("model", F.lit(metric).alias("metric"), "n")
        merged = self.index.substation_merge.where("id <> representative").select(*KEY)
        substations = self.grid.of_type("Substation").select(*KEY).join(merged, KEY, "left_anti")
        levels = self.grid.of_type("VoltageLevel").select(*KEY).join(self.index.level_sites.select("model", F.col("vl").alias("id")), KEY)
        counts = [count(substations, METRICS[0]), count(levels, METRICS[1]), self._placed_counts()]
        counts.append(self._transformer_counts())
        every = F.posexplode(F.array(*[F.lit(metric) for metric in METRICS])).alias("nth", "metric")
        rows = self.grid.objects.select("model").distinct().select("model", every)
        return rows.join(reduce(DataFrame.unionByName, counts), ["model", "metric"], "left").select("model", "nth", "metric", F.coalesce("n", F.lit(0)).alias("n"))
