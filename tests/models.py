"""Small models for the tests."""

from gridweft.operators.access import Grid
from gridweft.sources import rdfxml

RDF = '<?xml version="1.0"?>\n<rdf:RDF xmlns:cim="c" xmlns:rdf="r">{}</rdf:RDF>'


def thing(kind, name, props=None, refs=None, about=False):
    """One object; refs name ids without underscore, or whole URLs."""
    lines = [f"<cim:{k}>{v}</cim:{k}>" for k, v in (props or {}).items()]
    lines += [f'<cim:{k} rdf:resource="{v if ":" in v else "#_" + v}"/>' for k, v in (refs or {}).items()]
    attr = "rdf:about" if about else "rdf:ID"
    return f'<cim:{kind} {attr}="_{name}">' + "\n  ".join(lines) + f"</cim:{kind}>\n"


def grid_of(spark, *documents, names=None):
    """A Grid of whole XML texts; a pair is an equipment and a boundary document."""
    rows = []
    for i, doc in enumerate(documents):
        name = names[i] if names else f"m{i}"
        parts = doc if isinstance(doc, tuple) else (doc,)
        rows += [(name, part, text) for part, text in zip(("EQ", "EQBD"), parts, strict=False)]
    contents = spark.createDataFrame(rows, "model string, part string, content string")
    closed = rdfxml.closed(rdfxml.tags(contents)).cache()
    objects = rdfxml.objects(closed).cache()
    return Grid(objects, rdfxml.triples(closed, objects).cache())


def terminal(name, equipment, cn, seq=None):
    return thing("Terminal", name, {"ACDCTerminal.sequenceNumber": seq} if seq else {}, {"Terminal.ConductingEquipment": equipment} | ({"Terminal.ConnectivityNode": cn} if cn else {}))


def node(name, container):
    return thing("ConnectivityNode", name, {}, {"ConnectivityNode.ConnectivityNodeContainer": container})


NAME = "IdentifiedObject.name"


def conversion_model():
    """One of each kind of equipment, two levels, an inner line and a line to the boundary."""
    t, n = terminal, node
    machine = lambda i, props, refs: thing("SynchronousMachine", i, props, refs)
    parts = [
        thing("FullModel", "FM1", {"Model.scenarioTime": "2026-01-01T09:00:00Z", "Model.created": "2026-01-01T01:00:00Z", "Model.profile": "http://x/CoreEquipment-EU/3.0", "Model.description": "a+b &lt;c&gt;"}, {"Model.DependentOn": "urn:uuid:dep"}, about=True),
        thing("GeographicalRegion", "GR1", {NAME: "TestRegion"}),
        thing("SubGeographicalRegion", "SGR1", {NAME: "Sub"}, {"SubGeographicalRegion.Region": "GR1"}),
        thing("Substation", "SS1", {NAME: "One"}, {"Substation.Region": "SGR1"}),
        thing("Substation", "SS2", {NAME: "Two"}, {"Substation.Region": "SGR1"}),
        thing("FullModel", "FM_EQBD", {}, {}, about=True),
        thing("BaseVoltage", "BV220", {"BaseVoltage.nominalVoltage": "220"}),
        thing("VoltageLevel", "VL1", {NAME: "L1"}, {"VoltageLevel.Substation": "SS1", "VoltageLevel.BaseVoltage": "BV220"}),
        thing("VoltageLevel", "VL2", {NAME: "L2"}, {"VoltageLevel.Substation": "SS2", "VoltageLevel.BaseVoltage": "BV220"}),
        thing("ACLineSegment", "LINE_CTR"),
        *[n(f"CN_{x}", "VL1") for x in ("BusbarSection", "LOAD", "SHUNT", "SVC", "GEN_TH", "GEN_HY", "GEN_CO", "GEN_CU")],
        n("CN_VL2", "VL2"),
        n("CN_BNDRY", "LINE_CTR"),
        thing("BusbarSection", "BusbarSection1", {NAME: "B"}),
        t("BusbarSection1-T", "BusbarSection1", "CN_BusbarSection"),
        thing("EnergyConsumer", "LOAD1", {NAME: 'L"1'}),
        t("LOAD1-T", "LOAD1", "CN_LOAD"),
        thing("LinearShuntCompensator", "SHUNT1", {"ShuntCompensator.sections": "2", "ShuntCompensator.maximumSections": "4", "LinearShuntCompensator.bPerSection": "0.01", "LinearShuntCompensator.gPerSection": "0.001", "RegulatingCondEq.controlEnabled": "true"}),
        t("SHUNT1-T", "SHUNT1", "CN_SHUNT"),
        thing("StaticVarCompensator", "SVC1", {"StaticVarCompensator.bMin": "-0.05", "StaticVarCompensator.bMax": "0.05", "RegulatingCondEq.controlEnabled": "true"}, {"StaticVarCompensator.regulationMode": "http://c#SVCControlMode.voltage"}),
        t("SVC1-T", "SVC1", "CN_SVC"),
        thing("ThermalGeneratingUnit", "THG1", {"GeneratingUnit.minOperatingP": "50", "GeneratingUnit.maxOperatingP": "500"}),
        thing("FossilFuel", "FF1", {}, {"FossilFuel.ThermalGeneratingUnit": "THG1", "FossilFuel.fossilFuelType": "http://c#FuelType.coal"}),
        machine("GEN_TH", {"RotatingMachine.ratedS": "600", "SynchronousMachine.minQ": "-200", "SynchronousMachine.maxQ": "200"}, {"RotatingMachine.GeneratingUnit": "THG1"}),
        t("GEN_TH-T", "GEN_TH", "CN_GEN_TH"),
        thing("HydroGeneratingUnit", "HGU1"),
        machine("GEN_HY", {}, {"RotatingMachine.GeneratingUnit": "HGU1"}),
        t("GEN_HY-T", "GEN_HY", "CN_GEN_HY"),
        machine("GEN_CO", {"SynchronousMachine.qPercent": "50"}, {"SynchronousMachine.type": "http://c#SynchronousMachineKind.generatorOrCondenser"}),
        t("GEN_CO-T", "GEN_CO", "CN_GEN_CO"),
        thing("ReactiveCapabilityCurve", "RCC1"),
        thing("CurveData", "CD1", {"CurveData.xvalue": "100", "CurveData.y1value": "-150", "CurveData.y2value": "250"}, {"CurveData.Curve": "RCC1"}),
        machine("GEN_CU", {"SynchronousMachine.minQ": "-999", "SynchronousMachine.maxQ": "999"}, {"SynchronousMachine.InitialReactiveCapabilityCurve": "RCC1"}),
        t("GEN_CU-T", "GEN_CU", "CN_GEN_CU"),
        thing("ACLineSegment", "LINE1", {"ACLineSegment.r": "1", "ACLineSegment.x": "2", "ACLineSegment.gch": "4", "ACLineSegment.bch": "6"}),
        t("LINE1-T1", "LINE1", "CN_LOAD", 1),
        t("LINE1-T2", "LINE1", "CN_VL2", 2),
        thing("ACLineSegment", "LINE_BNDRY", {"ACLineSegment.r": "0.5", "ACLineSegment.x": "1"}),
        t("LINE_BNDRY-T1", "LINE_BNDRY", "CN_BusbarSection", 1),
        t("LINE_BNDRY-T2", "LINE_BNDRY", "CN_BNDRY", 2),
        thing("ControlArea", "CA1", {NAME: "TestArea"}),
        thing("TieFlow", "TF1", {}, {"TieFlow.ControlArea": "CA1", "TieFlow.Terminal": "LINE1-T1"}),
    ]
    return RDF.format("".join(parts))
