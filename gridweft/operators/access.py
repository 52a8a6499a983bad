"""Lookups, projections and counts over objects and triples."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweft.functions.scalars import strip_hash, strip_underscore
from gridweft.operators.sieve import sieved
from gridweft.storage import bucketed, stored

NAME, MRID = "IdentifiedObject.name", "IdentifiedObject.mRID"
KEY = ["model", "id"]


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass
class Grid:
    """Models as objects (model, doc_pos, close_pos, id, type, src_part) and triples (model, subj, subj_pos, pos, pred, text, ref)."""

    objects: DataFrame
    triples: DataFrame

    @cached_property
    def by_id(self) -> DataFrame:
        """One object an id, the last in document order, in buckets of the id: lookups leave it where it is."""
        return bucketed(self.last_objects(), "by-id", *KEY, dealt=True)

    def last_objects(self, where: Column | None = None) -> DataFrame:
        """As by_id, not stored; of the ids that ``where`` selects, if it is given."""
        return self._last(self.objects if where is None else self.objects.where(where))

    def last_objects_of(self, ids: DataFrame) -> DataFrame:
        """last_objects() of distinct stored ids (model, id); other objects are thinned out before the shuffle."""
        return self._last(sieved(self.objects, ids, KEY, ids.count())).join(ids.select(*KEY).hint("shuffle_merge"), KEY, "left_semi")

    def _last(self, rows: DataFrame) -> DataFrame:
        last = F.max(F.struct("doc_pos", *[c for c in self.objects.columns if c not in ("doc_pos", *KEY)])).alias("o")
        return rows.groupBy(*KEY).agg(last).select(*KEY, "o.*")

    @property
    def positioned(self) -> DataFrame:
        """The objects as they are joined by their positions."""
        return self.objects

    @property
    def tag_rows(self) -> DataFrame:
        """The triples for one reader, who takes few of them."""
        return self.triples

    def whole_objects(self) -> DataFrame | None:
        """The objects with their tags as structs (pos, pred, text, ref) in order; None where objects and tags come apart."""
        return None

    def of_type(self, *types: str) -> DataFrame:
        """Objects of classes."""
        return self.objects.where(F.col("type").isin(*types))

    def named_tags(self, names: Collection[str]) -> DataFrame:
        """Triples of listed names; where triples are stored by name, the folders of these alone are read."""
        return self.triples.where(F.col("pred").isin(*names))

    def view(self, types: list[str] | None, properties: dict[str, str] | None = None, references: dict[str, str] | None = None, source: DataFrame | None = None) -> DataFrame:
        """Objects (model, id, doc_pos, type) with a column for each named property and reference.

        The first tag of a name decides: a property is the text of the first tag that has one, a reference the target
        of the first tag whether it has one or not; leading ``#`` is dropped. One shuffle, and only tags that are named
        reach it.
        """
        base = source if source is not None else (self.objects if types is None else self.of_type(*types))
        properties, references = properties or {}, references or {}
        named = [*properties.values(), *references.values()]
        found = [F.expr(f"min_by(text, pos) FILTER (WHERE pred = {_quoted(p)} AND text IS NOT NULL)").alias(a) for a, p in properties.items()]
        found += [strip_hash(F.expr(f"min_by(ref, pos) FILTER (WHERE pred = {_quoted(p)})")).alias(a) for a, p in references.items()]
        chosen = base.select("model", "id", "doc_pos", "type")
        if not found:
            return chosen
        values = self.named_tags(set(named)).groupBy("model", F.col("subj_pos").alias("doc_pos")).agg(*found)
        return chosen.join(values, ["model", "doc_pos"], "left")

    def referring(self, types: list[str], properties: dict[str, str], references: dict[str, str], target: str) -> DataFrame:
        """view() with the class and position of what its reference ``target`` names, as <target>_type and <target>_pos, null where nothing has that id."""
        found = self.by_id.select("model", F.col("id").alias(target), F.col("type").alias(f"{target}_type"), F.col("doc_pos").alias(f"{target}_pos"))
        return stored(self.view(types, properties, references).join(found, ["model", target], "left"), "referring")

    def named(self, types: list[str] | None, properties: dict[str, str] | None = None, references: dict[str, str] | None = None) -> DataFrame:
        """view() with mrid (the id without an underscore where there is none) and name."""
        found = self.view(types, {"mrid": MRID, "name": NAME} | (properties or {}), references)
        return found.withColumn("mrid", F.coalesce("mrid", strip_underscore(F.col("id"))))

    def all_properties(self) -> DataFrame:
        """(model, subj, subj_pos, pred, value): the last text of every name."""
        return self.triples.where("text IS NOT NULL").groupBy("model", "subj", "subj_pos", "pred").agg(F.max_by("text", "pos").alias("value"))

    def all_references(self) -> DataFrame:
        """(model, subj, subj_pos, pred, value): the last target of every name."""
        return self.triples.where("ref IS NOT NULL").groupBy("model", "subj", "subj_pos", "pred").agg(F.max_by("ref", "pos").alias("value"))

    def deref(self, rows: DataFrame, column: str, prefix: str) -> DataFrame:
        """Rows with the id, type and position of the object that a reference column names, null where none does."""
        target = self.by_id.select("model", F.col("id").alias(f"{prefix}_id"), F.col("type").alias(f"{prefix}_type"), F.col("doc_pos").alias(f"{prefix}_pos"))
        return rows.join(target, (rows["model"] == target["model"]) & (rows[column] == target[f"{prefix}_id"]), "left").drop(target["model"])

    def type_counts(self) -> DataFrame:
        return self.objects.groupBy("model", "type").agg(F.count(F.lit(1)).alias("n"))

    def types_report(self) -> DataFrame:
        """Objects per class and, with a null class, of all classes."""
        return self.objects.rollup("model", "type").agg(F.count(F.lit(1)).alias("n")).where("model IS NOT NULL")

    def get_single(self, object_id: str, expected_type: str | None = None) -> DataFrame:
        """status (found, not_found, type_mismatch) of an id in every model, with the actual class."""
        models = self.objects.select("model").distinct()
        found = models.join(self.by_id.where(F.col("id") == object_id), "model", "left")
        wrong = F.lit(False) if expected_type is None else F.col("type") != expected_type
        status = F.when(F.col("id").isNull(), "not_found").when(wrong, "type_mismatch").otherwise("found")
        return found.select("model", F.lit(object_id).alias("id"), "type", status.alias("status"))

    def get_list(self, type_name: str, fields: str | None = None, missing: str = "N/A", references_too: bool = False) -> DataFrame:
        """Objects of a class with listed text properties, in document order; at most 32 fields, blanks around them dropped."""
        names = [f.strip(" ") for f in fields.split(",")] if fields else [NAME]
        if len(names) > 32:
            raise ValueError("at most 32 fields")
        refs = {f"r{i}": n for i, n in enumerate(names)} if references_too else {}
        found = self.view([type_name], {f"f{i}": n for i, n in enumerate(names)}, refs)
        value = lambda i: F.coalesce(F.col(f"f{i}"), F.col(f"r{i}") if references_too else F.lit(None), F.lit(missing))
        return found.select("model", "doc_pos", "id", "type", *[value(i).alias(n) for i, n in enumerate(names)])

    def get_count(self, type_name: str) -> DataFrame:
        return self.of_type(type_name).groupBy("model").agg(F.count(F.lit(1)).alias("n"))

    def hops(self) -> DataFrame:
        """Numbered references of every object: (model, subj, n, pred, target), in document order from 1."""
        refs = self.triples.where("ref IS NOT NULL")
        n = F.row_number().over(Window.partitionBy("model", "subj_pos").orderBy("pos"))
        return refs.select("model", "subj", n.alias("n"), "pred", strip_hash(F.col("ref")).alias("target"))

    def neighbourhood(self, start: Column, hops: int) -> DataFrame:
        """Objects within so many references of those that ``start`` selects: (model, id, distance), the least distance.

        References and objects are thinned out by a bitmap of a step's ids before they are joined, so that a step
        shuffles what it reaches, not the model.
        """
        edges = stored(self.tag_rows.where("ref IS NOT NULL").select("model", F.col("subj").alias("id"), strip_hash(F.col("ref")).alias("next")), "hops")
        picked = stored(self.objects.where(start).select(*KEY), "reach")
        # A start is chosen by the last object of its id.
        level = stored(self._last(sieved(self.objects, picked, KEY, picked.count())).where(start).select(*KEY, F.lit(0).alias("distance")), "reach")
        known = level
        for d in range(1, hops + 1):
            n = level.count()
            if not n:
                break
            ahead = sieved(edges, level, KEY, n).join(level.select(*KEY), KEY).select("model", F.col("next").alias("id")).distinct()
            ahead = stored(ahead.join(known.select(*KEY), KEY, "left_anti"), "reach")
            there = sieved(self.objects.select(*KEY), ahead, KEY, ahead.count())
            level = stored(ahead.join(there, KEY, "left_semi").select(*KEY, F.lit(d).alias("distance")), "reach")
            known = known.unionByName(level)
        return known
