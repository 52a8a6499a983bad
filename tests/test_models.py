import functools
import io
import json
import re
import zipfile

import numpy as np
import pytest
from models import NAME, RDF, grid_of, thing
from pyspark.sql import functions as F

from gridweft import cli
from gridweft.operators import components, ordered
from gridweft.operators import diff as D
from gridweft.plans.convert import METRICS
from gridweft.sources import rdfxml, sinks
from gridweft.streaming.versions import watch


def test_objects_in_order(spark):
    grid = grid_of(spark, RDF.format(thing("A", "1") + '<cim:B rdf:ID="_2"/>' + thing("A", "3", about=True) + "<!-- <x> -->"))
    rows = grid.objects.orderBy("doc_pos").collect()
    assert [(r["type"], r["id"]) for r in rows] == [("A", "_1"), ("B", "_2"), ("A", "_3")]
    assert {(r["type"], r["n"]) for r in grid.types_report().collect()} == {("A", 2), ("B", 1), (None, 3)}


def test_first_and_last_of_duplicates(spark):
    body = '<cim:A rdf:ID="_1"><cim:p>one</cim:p><cim:p>two</cim:p><cim:r/><cim:r rdf:resource="#_x"/><cim:q rdf:resource=""> t </cim:q></cim:A>'
    grid = grid_of(spark, RDF.format(body))
    row = grid.view(["A"], {"p": "p", "q": "q"}, {"r": "r", "q_ref": "q"}).first()
    assert (row["p"], row["r"], row["q"], row["q_ref"]) == ("one", None, " t ", "")
    assert {(r["pred"], r["value"]) for r in grid.all_properties().collect()} == {("p", "two"), ("q", " t ")}
    assert {(r["pred"], r["value"]) for r in grid.all_references().collect()} == {("r", "#_x"), ("q", "")}


def test_nested_objects(spark):
    body = '<cim:A rdf:ID="_1"><cim:B rdf:ID="_2"><cim:p>in</cim:p></cim:B><cim:p>out</cim:p></cim:A>'
    grid = grid_of(spark, RDF.format(body))
    got = {(r["id"], r["p"]) for r in grid.view(["A", "B"], {"p": "p"}).collect()}
    assert got == {("_1", "in"), ("_2", "in")}


@pytest.mark.parametrize("width", [2, 1 << 16])
def test_ordered(spark, width):
    """Next values, last values and sums over ranges of positions are those over the whole order."""
    rng = np.random.default_rng(1)
    rows = [(f"m{rng.integers(0, 2)}", int(p), int(v), int(v) if rng.random() < 0.3 else None) for p, v in zip(rng.permutation(200)[:80], rng.integers(-5, 6, 80), strict=True)]
    df = spark.createDataFrame(rows, "model string, pos long, v long, n long")
    out = ordered.next_value(df, ["model"], "pos", F.col("v"), "next", width)
    out = ordered.last_value_before(out, ["model"], "pos", F.col("n"), "last", width)
    got = {(r["model"], r["pos"]): (r["next"], r["last"], r["sum"]) for r in ordered.running_sum(out, ["model"], "pos", F.col("v"), "sum", width).collect()}
    for model in ("m0", "m1"):
        own = sorted(r[1:] for r in rows if r[0] == model)
        for i, (pos, _, _) in enumerate(own):
            before = [n for _, _, n in own[:i] if n is not None]
            assert got[(model, pos)] == (own[i + 1][1] if i + 1 < len(own) else None, before[-1] if before else None, sum(v for _, v, _ in own[: i + 1]))


def random_xml(rng, depth=0):
    """Balanced elements, some of them objects, some within others; and what every object encloses."""
    parts = []
    for _ in range(rng.integers(0, 5 - depth) if depth else 12):
        name = f"e{rng.integers(0, 4)}"
        attr = f' rdf:ID="_{rng.integers(0, 10**9)}"' if rng.random() < 0.6 else ""
        parts.append(f"<c:{name}{attr}/>" if rng.random() < 0.3 else f"<c:{name}{attr}>t{random_xml(rng, depth + 1)}</c:{name}>")
    return "".join(parts)


@pytest.mark.parametrize("width", [3, 1 << 16])
def test_triples_of_random_models(spark, monkeypatch, width):
    """Balanced models through windows against the stack; triples against a walk over the elements."""
    for kind in ("next_value", "last_value_before", "running_sum"):
        monkeypatch.setattr(rdfxml, kind, functools.partial(getattr(ordered, kind), width=width))
    monkeypatch.setattr(rdfxml, "NEST_RANGE", width)
    rng = np.random.default_rng(7)
    texts = [RDF.format(random_xml(rng)) for _ in range(6)]
    contents = spark.createDataFrame([(f"m{i}", "EQ", t) for i, t in enumerate(texts)], "model string, part string, content string")
    closed = rdfxml.closed(rdfxml.tags(contents)).cache()
    objects = rdfxml.objects(closed).cache()
    got = {(r["model"], r["subj"], r["pos"]) for r in rdfxml.triples(closed, objects).collect()}
    want, ends = set(), set()
    for i, text in enumerate(texts):
        around, open_ = [], []
        for pos, tag in enumerate(text.split("<")[1:], 1):
            if tag.startswith("?"):
                continue
            if tag.startswith("/"):
                start, subject = open_.pop()
                ends.add((f"m{i}", start, pos))
                if subject:
                    around.pop()
                continue
            want |= {(f"m{i}", s, pos) for s in around}
            found = re.search('rdf:ID="([^"]*)"', tag.split(">")[0])
            if not tag.split(">")[0].endswith("/"):
                open_.append((pos, bool(found)))
                if found:
                    around.append(found[1])
    assert got == want
    assert {(r["model"], r["pos"], r["close_pos"]) for r in closed.where("kind = 1").collect()} == ends


def test_unbalanced_replays_the_stack(spark):
    contents = spark.createDataFrame([("m", "EQ", "<a><br><b></b></a>")], "model string, part string, content string")
    rows = rdfxml.closed(rdfxml.tags(contents), namespaced=False).collect()
    assert {(r["name"], r["pos"], r["close_pos"]) for r in rows if r["kind"] == 1} == {("a", 1, 1), ("br", 2, 2), ("b", 3, 4)}


def test_attributes_or_errors(spark):
    tags = spark.createDataFrame([('cim:A rdf:ID="_1"',)], "tag string")
    assert tags.select(rdfxml.rdf_id(F.col("tag"))).first()[0] == "_1"
    for text, read, error in (('cim:A rdf:about="x"', rdfxml.rdf_id, "NoRdfId"), ("cim:A", rdfxml.rdf_about, "NoRdfAbout"), ('cim:A rdf:ID="_1', rdfxml.rdf_id, "MalformedTag")):
        with pytest.raises(Exception, match=error):
            spark.createDataFrame([(text,)], "tag string").select(read(F.col("tag"))).collect()


def test_attribute_positions(spark):
    """Positions in bytes, also behind longer characters and where the next occurrence closes a quote."""
    text = '<é a="x"/><b a="ü"/><c a="y><d a="z"/> a="open'
    rows = rdfxml.attribute_positions(spark.createDataFrame([("m", "EQ", text)], "model string, part string, content string"), "a").orderBy("start").collect()
    data, want, at = text.encode(), [], -1
    while (at := data.find(b'a="', at + 1)) >= 0:
        end = data.find(b'"', at + 3)
        if end >= 0:
            want.append((at, at + 3, end - at - 3, data[at + 3 : end].decode()))
    assert [tuple(r)[2:] for r in rows] == want


def test_closing_tag(spark):
    contents = spark.createDataFrame([("m", "EQ", "<a><b/><a><c></c></a></a><a/><d>")], "model string, part string, content string")
    tags = rdfxml.tags(contents)
    close = lambda pos: rdfxml.closing_tag(tags, F.col("pos") == pos, namespaced=False).first()["close_pos"]
    assert [close(p) for p in (1, 3, 4)] == [7, 6, 5]
    for pos, error in ((8, "SelfClosingTag"), (9, "NoClosingTag")):
        with pytest.raises(Exception, match=error):
            close(pos)


def test_malformed(spark):
    contents = spark.createDataFrame([("m", "EQ", "<a> > </a>")], "model string, part string, content string")
    with pytest.raises(Exception, match="MalformedXML"):
        rdfxml.tags(contents).collect()


def test_zip(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("dir/", "")
        z.writestr("a.xml", "<a:B/>")
    (tmp_path / "x.bin").write_bytes(data.getvalue())
    (tmp_path / "y.xml").write_text("<a:C/>")
    got = {r["content"] for r in rdfxml.read_files(spark, str(tmp_path)).collect()}
    assert got == {"<a:B/>", "<a:C/>"}
    bad = io.BytesIO()
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("../x", "")
    with pytest.raises(ValueError, match="unsafe"):
        rdfxml.unzip(bad.getvalue())


@pytest.fixture(scope="module")
def versions(spark):
    old = RDF.format(thing("A", "1", {NAME: "x", "p": "1"}) + thing("A", "2") + thing("B", "3", {}, {"r": "1"}))
    new = RDF.format(thing("B", "3", {}, {"r": "4"}) + thing("A", "1", {"p": "2", NAME: "x"}) + thing("C", "5", {NAME: 'q"'}))
    return grid_of(spark, old), grid_of(spark, new)


def test_diff(versions):
    old, new = versions
    assert {(r["id"], r["status"]) for r in D.diff_status(old, new).collect()} == {("_2", "removed"), ("_5", "added"), ("_1", "changed"), ("_3", "changed")}
    assert {(r["pred"], r["old"], r["new"]) for r in D.diff_fields(old, new).collect()} == {("p", "1", "2"), ("r", "#_1", "#_4")}
    assert not D.had_diffs(old, old) and D.had_diffs(old, new) and not D.had_diffs(old, new, ["Z"])
    lines = {r["type"]: r["line"] for r in D.diff_summary_text(old, new).collect()}
    assert lines == {"A": "A  +0 -1 ~1", "B": "B  +0 -0 ~1", "C": "C  +1 -0 ~0"}


def test_diff_renderings(versions):
    old, new = versions
    texts = [r["line"] for r in D.diff_text(old, new).orderBy("sort_type", "sort_id").collect()]
    assert texts[:3] == ["--- old\n+++ new", "@@ A @@", '~ _1  "x"\n  - p: "1"\n  + p: "2"']
    lines = {r["id"]: r["line"] for r in D.diff_ndjson(old, new).collect()}
    assert lines["_1"] == '{"type":"A","mrid":"_1","status":"changed","changes":[{"property":"p","from":"1","to":"2"}]}'
    assert lines["_5"] == '{"type":"C","mrid":"_5","status":"added"}'


def test_diff_single(versions):
    old, new = versions
    status = lambda i, t=None: D.diff_single(old, new, i, t).first()
    assert [status(i)["status"] for i in ("_1", "_2", "_5", "_9")] == ["changed", "removed", "added", "not_found"]
    assert (status("_1", "B")["status"], status("_1", "B")["type"]) == ("type_mismatch", "A")
    assert D.diff_single(old, old, "_1").first()["status"] == "same"


def test_single_reports(spark, versions):
    old, new = versions
    report = lambda i, f=D.single_text: [r["line"] for r in (f(old, new, i).orderBy("sort_id") if f is D.single_text else f(*D.single(old, new, i))).collect()]
    assert report("_1") == ["--- old\n+++ new", '~ _1  "x"\n  - p: "1"\n  + p: "2"']
    assert report("_2") == ["--- old\n+++ new", '- _2  ""'] and report("_5")[1:] == ['+ _5  "q""']
    assert [r["line"] for r in D.single_text(old, old, "_1").collect()] == ["--- old\n+++ new"]
    assert report("_1", D.diff_ndjson) == ['{"type":"A","mrid":"_1","status":"changed","changes":[{"property":"p","from":"1","to":"2"}]}']
    assert report("_1", D.diff_summary_text) == ["A  +0 -0 ~1"] and report("_5", D.diff_summary_text) == ["C  +1 -0 ~0"]
    assert [r["line"] for r in D.diff_ndjson(*D.single(old, old, "_1")).collect()] == []
    moved = grid_of(spark, RDF.format(thing("Z", "1", {NAME: "x", "p": "3"})))
    assert [r["line"] for r in D.diff_summary_text(*D.single(old, moved, "_1")).collect()] == ["A  +0 -0 ~1"]


def test_reordered_objects_are_equal(spark):
    """Objects whose tags differ in order alone have no differences; the last of equal names counts."""
    old = RDF.format(thing("A", "1", {"p": "1", "q": "2"}) + '<cim:A rdf:ID="_2"><cim:p>1</cim:p><cim:p>2</cim:p></cim:A>')
    new = RDF.format(thing("A", "1", {"q": "2", "p": "1"}) + '<cim:A rdf:ID="_2"><cim:p>2</cim:p><cim:p>1</cim:p></cim:A>')
    found = D.diff_fields(grid_of(spark, old), grid_of(spark, new)).collect()
    assert [(r["id"], r["old"], r["new"]) for r in found] == [("_2", "2", "1")]


def test_versions_survive_a_restart(spark, tmp_path):
    """A stream that starts again compares with the version before the restart."""
    schema = "model string, part string, content string"
    seen = []

    def run(doc):
        spark.createDataFrame([("m", "EQ", doc)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        versions = watch(spark, stream, f"file://{tmp_path}/check", lambda n, rows: seen.append((n, sorted((r["id"], r["status"]) for r in rows.collect()))))
        versions.awaitTermination()

    run(RDF.format(thing("A", "1", {"p": "1"}) + thing("A", "2")))
    run(RDF.format(thing("A", "1", {"p": "2"}) + thing("A", "2")))
    run(RDF.format(thing("A", "1", {"p": "2"}) + thing("A", "3")))
    assert seen == [(0, [("_1", "added"), ("_2", "added")]), (1, [("_1", "changed")]), (2, [("_2", "removed"), ("_3", "added")])]


def test_cli(spark, tmp_path, capsys):
    old, new = RDF.format(thing("A", "1", {NAME: "x"}) + thing("B", "2", {}, {"r": "1"})), RDF.format(thing("A", "1", {NAME: "y"}) + thing("B", "2", {}, {"r": "1"}))
    for name, text in (("a.xml", old), ("b.XML", new)):
        (tmp_path / name).write_text(text)
    a, b = f"{tmp_path}/a.xml", f"{tmp_path}/b.XML"

    def run(*args):
        code = cli.main(list(args), spark)
        return code, capsys.readouterr()

    code, out = run("types", a)
    assert code == 0 and out.out.splitlines() == ["A  1", "B  1", "total  2"]
    code, out = run("get", a, "--mrid", "_2", "--json")
    assert code == 0 and json.loads(out.out) == {"id": "_2", "type": "B", "properties": {}, "references": {"r": "_1"}}
    assert run("get", a, "--mrid", "_9")[0] == 1 and run("get", a)[0] == 2
    assert run("get", a, "--type", "A", "--count")[1].out == "1\n"
    assert run("diff", a, a)[0] == 0 and run("diff", a, b, "--summary") == (1, ("A  +0 -0 ~1\n", ""))
    code, out = run("diff", a, b, "--mrid", "_1")
    assert code == 1 and out.out == f'--- {a}\n+++ {b}\n~ _1  "y"\n  - {NAME}: "x"\n  + {NAME}: "y"\n'
    assert run("diff", a, b, "--mrid", "_2")[0] == 0 and run("diff", a, b, "--mrid", "_9")[0] == 1
    code, out = run("diff", a, b, "--mrid", "_1", "--type", "B")
    assert code == 2 and "is of type 'A', not 'B'" in out.err
    assert run("browse", a, "--mrid", "_2", "--hops", "1")[1].out.splitlines() == ["0  B  _2", "1  B -> A  _1"]
    code, out = run("convert", a, "--output", f"{tmp_path}/out.json")
    assert code == 0 and out.out.splitlines() == [f"{m}: 0" for m in METRICS]
    assert json.loads((tmp_path / "out.json").read_text())["substations"] == []
    for wrong in (["types", "x.txt"], ["nothing"], ["get"]):
        with pytest.raises(SystemExit) as stopped:
            cli.main(wrong, spark)
        assert stopped.value.code == 2
    capsys.readouterr()


def test_sinks(versions):
    old, _ = versions
    assert sinks.object_json(old, ["B"]).first()["json"] == '{"id":"_3","type":"B","properties":{},"references":{"r":"_1"}}'
    assert [r["line"] for r in sinks.objects_text(old, "A").orderBy("nth").collect()] == ["[1] _1\nA _1\n  IdentifiedObject.name: x\n  p: 1", "[2] _2\nA _2"]
    assert sinks.list_json(old, "A", "p").first()["json"] == '[{"id":"_1","type":"A","p":"1"},{"id":"_2","type":"A","p":""}]'
    assert sinks.types_json(old).first()["json"] == '[{"type":"A","count":2},{"type":"B","count":1}]'
    assert sinks.object_text(old, "_1").first()["line"] == "A _1\n  IdentifiedObject.name: x\n  p: 1"


@pytest.mark.parametrize("small", [0, 50_000])
def test_components(spark, monkeypatch, small):
    """Stars and the one task find the same components, of numbers and of texts."""
    monkeypatch.setattr(components, "SMALL", small)
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(70, 70), (71, 71)]
    part = {x: x for e in edges for x in e}
    for _ in part:
        for a, b in edges:
            part[a] = part[b] = min(part[a], part[b])
    for kind, as_ in (("long", int), ("string", lambda x: f"{x:03}")):
        df = spark.createDataFrame([(as_(a), as_(b)) for a, b in edges] + [(None, as_(5))], f"a {kind}, b {kind}")
        assert {tuple(r) for r in components.connected_components(df).collect()} == {(as_(x), as_(c)) for x, c in part.items()}


def test_access(versions):
    old, _ = versions
    assert old.get_single("_1", "B").first()["status"] == "type_mismatch" and old.get_single("_7").first()["status"] == "not_found"
    assert old.get_count("A").first()["n"] == 2
    assert [r["p"] for r in old.get_list("A", "p").orderBy("doc_pos").collect()] == ["1", "N/A"]
    assert {(r["id"], r["distance"]) for r in old.neighbourhood(F.col("id") == "_3", 2).collect()} == {("_3", 0), ("_1", 1)}


def test_marks_tell_order_of_repeated_names_and_kinds_of_values(spark):
    """The last of equal names counts, and a text is no reference; a class change leaves either side its own name."""
    same = thing("A", "9", {"p": "1", "q": "2"})
    old = grid_of(spark, RDF.format(same + '<cim:A rdf:ID="_1"><cim:p>a</cim:p><cim:p>b</cim:p></cim:A>' + '<cim:A rdf:ID="_2"><cim:p>a</cim:p></cim:A>' + thing("A", "3", {"IdentifiedObject.name": "old"})))
    new = grid_of(spark, RDF.format('<cim:A rdf:ID="_1"><cim:p>b</cim:p><cim:p>a</cim:p></cim:A>' + '<cim:A rdf:ID="_2"><cim:p rdf:resource="a"/></cim:A>' + thing("B", "3") + thing("A", "9", {"q": "2", "p": "1"})))
    assert {(r["id"], r["kind"], r["old"], r["new"]) for r in D.diff_fields(old, new).collect()} == {("_1", "property", "b", "a"), ("_2", "property", "a", None), ("_2", "reference", None, "a")}
    lines = {(r["sort_type"], r["sort_id"]): r["line"] for r in D.diff_text(old, new).collect()}
    assert lines[("A", "_3")] == '- _3  "old"' and lines[("B", "_3")] == '+ _3  ""'


def test_sieve_keeps_every_row_that_joins(spark, monkeypatch):
    from gridweft.operators import sieve

    monkeypatch.setattr(sieve, "FEW", 10)
    rows = spark.range(200_000).select(F.lit("m").alias("model"), F.col("id").alias("doc_pos"))
    keys = rows.where("doc_pos % 199 = 3")
    passed = sieve.sieved(rows, keys, ["model", "doc_pos"], keys.count())
    assert passed.join(keys, ["model", "doc_pos"], "left_semi").count() == keys.count()
    assert passed.count() < 30_000
    plan = passed._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_marks_reach_the_shuffle_as_one_row_an_object(spark):
    """A hundred tags of one object in one partition are one row; texts stay where they are."""
    tags = spark.range(0, 100, 1, 2).select(F.lit("m").alias("model"), F.lit("_1").alias("subj"), F.lit(1).cast("long").alias("subj_pos"), (F.col("id") + 2).alias("pos"), F.concat(F.lit("p"), "id").alias("pred"), F.lit("text").alias("text"), F.lit(None).cast("string").alias("ref"))
    plan = D.mark(D.Grid(None, tags))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_bit_xor") > plan.index("Exchange") and "text#" not in plan[: plan.index("Exchange")]
