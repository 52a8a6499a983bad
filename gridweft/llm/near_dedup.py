"""Near-duplicate groups by an LSH forest over MinHash signatures.

Documents with equal shingle sets are one class; classes are numbered in the order of their smallest ids, and all that
follows goes by these numbers, as several texts may share an id or have none. Every class gets a signature of
COMPONENTS minima. A tree of the forest is an order of the components: classes are range-sorted by their signature in
that order, so that a class stands beside those with which it shares the longest prefix; the prefix that neighbours
share grows with the density of their region. Neighbours with a common prefix of DEPTH components and enough agreement
behind it are candidates if their whole signatures agree in LEAST_ALL components, which classes that share no more than
a template don't.

Components of candidates are clusters, and links are only looked for within a cluster, on full shingle sets: first in
chunks of a cluster, each with the cluster's hubs, which are the classes with most candidates and those that agree best
with the cluster's most frequent components, as the original of many copies does; then what is not yet linked to the
cluster's main part is compared, in blocks, with every class of the cluster. Pairs that are linked through others need
no comparison, and only links of a spanning forest are written, so that a large group costs rows in proportion to its
size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweft import storage
from gridweft.llm import tokens
from gridweft.operators.components import connected_components

#: Trees, the components that a candidate's prefix must share, and those compared behind it with the least agreement.
TREES, DEPTH, BEHIND, LEAST_BEHIND = 20, 4, 20, 8
COMPONENTS = TREES * DEPTH
#: Components in which the signatures of candidates agree, at least; of 80, a similarity of 0.8 gives fewer in 3 of 100,000 cases.
LEAST_ALL = 50
#: Classes of a cluster that are compared in one task at once, and hubs that each such chunk gets.
CHUNK, HUBS = 512, 8
#: Parts of a cluster that join what is known of the whole cluster.
SALTS = 64

_random = np.random.Generator(np.random.PCG64(7))
_FACTORS = _random.integers(0, 2**63, COMPONENTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _random.integers(0, 2**63, COMPONENTS, dtype=np.uint64)


def _tree_orders() -> list[np.ndarray]:
    """For each tree its own DEPTH components, then BEHIND others at random."""
    out = []
    for t in range(TREES):
        own = np.arange(t * DEPTH, (t + 1) * DEPTH)
        others = np.setdiff1d(np.arange(COMPONENTS), own)
        out.append(np.concatenate([own, _random.permutation(others)[:BEHIND]]))
    return out


_ORDERS = _tree_orders()


def shingle_sets(column: pa.Array, n_words: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted shingle hashes of each document): ``n_words``-word shingles of A-Z lower-cased words.

    A document with fewer words has its whole sequence as one shingle; one without words has none.
    """
    for row, data, offsets in tokens.text_blocks(column):
        words = tokens.Words(tokens.lowered(data), offsets)
        h = words.hashes()
        grams = tokens.ngrams(h, n_words)
        sets = []
        for first, last in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            if last - first >= n_words:
                sets.append(np.unique(grams[first : last - n_words + 1]))
            elif last > first:
                one = np.uint64((last - first) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)
                for value in h[first:last]:
                    one = tokens.mixed(np.array([value ^ one]))[0]
                sets.append(np.array([one], np.uint64))
            else:
                sets.append(np.zeros(0, np.uint64))
        yield row, sets


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash signatures of non-empty sets: a row of COMPONENTS 16-bit values for each."""
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])[:-1]
    out = np.empty((len(sets), COMPONENTS), np.uint16)
    for k in range(COMPONENTS):
        least = np.minimum.reduceat((flat ^ _MASKS[k]) * _FACTORS[k], at)
        out[:, k] = tokens.mixed(least) >> np.uint64(48)
    return out


def _sign(n_words: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sets in shingle_sets(batch.column(2), n_words):
                full = [i for i, s in enumerate(sets) if len(s)]
                signature: list[bytes | None] = [None] * len(sets)
                digest: list[bytes | None] = [None] * len(sets)
                if full:
                    rows = signatures([sets[i] for i in full]).astype(">u2")
                    for i, values in zip(full, rows, strict=True):
                        signature[i] = values.tobytes()
                        digest[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                ids, text_hash = (batch.column(k).slice(row, len(sets)) for k in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [ids, text_hash, pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(signature, pa.binary())],
                    names=["id", "text_hash", "n", "digest", "signature"],
                )

    return sign


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each class and tree: key (tree, then components in its order) and id, the class."""
    for batch in batches:
        if not len(batch):
            continue
        values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(batch), COMPONENTS, 2)
        for t, order in enumerate(_ORDERS):
            key = np.empty((len(batch), 1 + 2 * len(order)), np.uint8)
            key[:, 0] = t
            key[:, 1:] = values[:, order].reshape(len(batch), -1)
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(key.shape[1]), len(batch), [None, pa.py_buffer(key.tobytes())])
            yield pa.RecordBatch.from_arrays([raw.cast(pa.binary()), batch.column(0)], names=["key", "id"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates (a, b) among rows sorted by key; the rows at both ends come back with b null, for what lies across."""
    width = 1 + 2 * (DEPTH + BEHIND)
    names = ["a", "b", "key"]
    keys, ids = np.zeros((0, width), np.uint8), np.zeros(0, np.int64)
    seen = 0

    def ends(k: np.ndarray, i: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(i), pa.nulls(len(i), pa.int64()), pa.array([x.tobytes() for x in k], pa.binary())], names=names)

    for batch in batches:
        if not len(batch):
            continue
        new = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(len(batch), width)
        if not seen:
            yield ends(new[:2], batch.column(1).to_numpy()[:2])
        seen += len(batch)
        keys, ids = np.concatenate([keys, new]), np.concatenate([ids, batch.column(1).to_numpy()])
        for gap in (1, 2):
            if len(keys) <= gap:
                continue
            same = keys[gap:] == keys[:-gap]
            near = same[:, : 1 + 2 * DEPTH].all(axis=1)
            pairs = same[:, 1 + 2 * DEPTH :].reshape(len(same), BEHIND, 2).all(axis=2).sum(axis=1) >= LEAST_BEHIND
            at = np.flatnonzero(near & pairs & (ids[gap:] != ids[:-gap]))
            if len(at):
                a, b = ids[at], ids[at + gap]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b)), pa.nulls(len(at), pa.binary())], names=names)
        keys, ids = keys[-2:], ids[-2:]
    if seen:
        yield ends(keys, ids)


def candidates(classes: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = storage.stored) -> DataFrame:
    """Distinct candidates (a, b), a > b, of classes (class, signature)."""
    schema = "a long, b long, key binary"
    rows = classes.select("class", "signature").mapInArrow(_trees, "key binary, id long")
    rows = rows.repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    scanned = keep(storage.in_few_files(rows.mapInArrow(_neighbours, schema), 2 * TREES * classes.count()), "near-scan")
    # Two rows from each end of each partition: as many as partitions, times four.
    edges = scanned.where("b IS NULL").select("key", F.col("a").alias("id")).repartition(1).sortWithinPartitions("key", "id")
    across = edges.mapInArrow(_neighbours, schema)
    near = scanned.unionByName(across).where("b IS NOT NULL").select("a", "b").distinct()
    signature = lambda n: classes.select(F.col("class").alias(n), F.col("signature").alias(f"s{n}"))
    return near.join(signature("a"), "a").join(signature("b"), "b").select("a", "b", "sa", "sb").mapInArrow(_agreeing, "a long, b long")


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u2").reshape(len(column), COMPONENTS)


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree in LEAST_ALL components."""
    for batch in batches:
        same = (_signatures(batch.column(2)) == _signatures(batch.column(3))).sum(axis=1) >= LEAST_ALL
        yield batch.select(["a", "b"]).filter(pa.array(same))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cluster, component, value, n) of the signatures (cluster, signature) of a batch."""
    for batch in batches:
        if not len(batch):
            continue
        clusters, place = np.unique(batch.column(0).to_numpy(), return_inverse=True)
        votes = (place[:, None] * COMPONENTS + np.arange(COMPONENTS)) << 16 | _signatures(batch.column(1))
        votes, n = np.unique(votes, return_counts=True)
        at = votes >> 16
        columns = [clusters[at // COMPONENTS], (at % COMPONENTS).astype(np.int32), (votes & 0xFFFF).astype(np.int32), n.astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cluster", "component", "value", "n"])


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, cluster, agreement) of (class, cluster, signature, usual values)."""
    for batch in batches:
        if len(batch):
            usual = batch.column(3).flatten().to_numpy().reshape(len(batch), COMPONENTS)
            same = (_signatures(batch.column(2)) == usual).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same, pa.int64())], names=["class", "cluster", "agreement"])


def _spread(clusters: DataFrame) -> DataFrame:
    """What is known of whole clusters, once for each salt."""
    return clusters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _salted(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int"))


def _hubs(large: DataFrame, classes: DataFrame, ends: DataFrame) -> DataFrame:
    """(id) of the hubs of large clusters (class, cluster): in each of HUBS shares of a cluster the best two."""
    signed = large.select("class", "cluster").join(classes.select("class", "signature"), "class")
    votes = signed.select("cluster", "signature").mapInArrow(_votes, "cluster long, component int, value int, n long")
    usual = votes.groupBy("cluster", "component", "value").agg(F.sum("n").alias("n")).groupBy("cluster", "component").agg(F.max(F.struct("n", "value")).alias("most"))
    usual = usual.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("component", F.col("most.value").alias("value")))), lambda x: x["value"]).alias("usual"))
    agreed = _salted(signed, "class").join(_spread(usual), ["cluster", "salt"]).select("class", "cluster", "signature", "usual").mapInArrow(_agreement, "class long, cluster long, agreement long")
    share = F.pmod(F.hash("class"), F.lit(HUBS)).alias("nth")
    best = agreed.join(ends, "class").groupBy("cluster", share).agg(F.max(F.struct("agreement", "class")).alias("x"), F.max(F.struct("degree", "class")).alias("y"))
    return best.select(F.explode(F.array_distinct(F.array("x.class", "y.class"))).alias("id"))


class _Roots:
    """Union-find over places 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, k: int) -> bool:
        i, k = self.find(i), self.find(k)
        self.up[max(i, k)] = min(i, k)
        return i != k


def links(ids: np.ndarray, sets: list[np.ndarray], percent: int, part: np.ndarray | None = None, only: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of a spanning forest: pairs of ids with 100 * intersection >= percent * union, found on full sets.

    ``part``: what is known to be linked. ``only``: rows of which one must be in a pair.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    sizes = np.array([len(sets[i]) for i in order])
    flat = np.concatenate([sets[i] for i in order])
    terms, flat = np.unique(flat, return_inverse=True)
    at = np.concatenate([[0], np.cumsum(sizes)])
    roots = _Roots(len(sets))
    if part is not None:
        lead: dict[int, int] = {}
        for i, k in enumerate(order):
            roots.join(i, lead.setdefault(int(part[k]), i))
    pivots = range(len(sets)) if only is None else [i for i, k in enumerate(order) if only[k]]
    found = []
    mark = np.zeros(len(terms), bool)
    for p in pivots:
        # Sizes ascend; a smaller set is compared when it is the pivot, unless only some rows are.
        low = p + 1 if only is None else int(np.searchsorted(sizes, -(-percent * sizes[p] // 100)))
        high = int(np.searchsorted(sizes, 100 * sizes[p] // percent, "right"))
        own = roots.find(p)
        others = [q for q in range(low, high) if q != p and roots.find(q) != own]
        if not others:
            continue
        low, high = others[0], others[-1] + 1
        mark[flat[at[p] : at[p + 1]]] = True
        common = np.add.reduceat(mark[flat[at[low] : at[high]]].astype(np.int64), at[low:high] - at[low])
        mark[flat[at[p] : at[p + 1]]] = False
        linked = 100 * common >= percent * (sizes[p] + sizes[low:high] - common)
        for q in np.flatnonzero(linked) + low:
            if q != p and roots.join(p, int(q)):
                a, b = int(ids[order[p]]), int(ids[order[q]])
                found.append((max(a, b), min(a, b)))
    return found


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal keys from sorted batches."""
    held: list[pa.Table] = []
    last: tuple | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        columns = [table.column(k).to_numpy() for k in keys]
        new = np.zeros(len(table), bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), len(table)]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if s == e:
                continue
            key = tuple(c[s] for c in columns)
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(s, e - s))
            last = key
    if held:
        yield pa.concat_tables(held)


def _link(percent: int, keys: list[str]):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, keys):
            ids = group.column("id").to_numpy()
            _, once = np.unique(ids, return_index=True)  # a hub is also a row of its own chunk
            group = group.take(pa.array(once))
            sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
            part, only = (group.column(k).to_numpy() if k in group.column_names else None for k in ("part", "only"))
            found = links(ids[once], sets, percent, part, only)
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return link


def _sets(n_words: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, found in shingle_sets(batch.column(1), n_words):
                rest = [batch.column(k).slice(row, len(found)) for k in (0, 2, 3, 4)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array([s.tobytes() for s in found], pa.binary())], names=["id", "cluster", "chunks", "chunk", "shingles"])

    return sets


def _same_id(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of rows (id, digest) that share an id: of each with the smallest."""
    mark = F.xxhash64("digest")
    shared = rows.groupBy("id").agg(F.min(mark).alias("low"), F.max(mark).alias("high")).where("low <> high").select("id")
    found = rows.select("id", "digest").join(shared, "id", "left_semi").join(classes.select("digest", "class"), "digest").select("id", "class").distinct()
    return found.join(found.groupBy("id").agg(F.min("class").alias("b")), "id").where("class <> b").select(F.col("class").alias("a"), "b")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, percent: int = 80, hashed: bool = False) -> DataFrame:
    """Groups of near duplicates: (id_col, n_shingles, component_id, kept), one row per row of ``docs``.

    Documents are linked when the Jaccard similarity of their sets of ``n_words``-word shingles is ``percent`` / 100 or
    more; a group is a component of links and its smallest id is kept. Null and empty texts, and texts without words,
    have no shingles and are linked with nothing. Rows that share an id are one document: what is linked with one is
    linked with the others. A null id is no id that is shared: every text without an id is a document of its own. A null
    id is larger than all others, and comes back null; of a group without ids one text is kept. Other columns are not
    read. An empty table gives no rows. Shingles are 64-bit hashes, sets are told apart by a 128-bit digest. With
    ``hashed`` a column text_hash, xxhash64 of the text, tells rows of an id apart.
    """
    schema = "id long, text_hash long, n long, digest binary, signature binary"
    last = 2**63 - 1
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(last)).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    signed = storage.stored(base.mapInArrow(_sign(n_words), schema), "near-signed")
    full = signed.where("digest IS NOT NULL")
    first = full.groupBy("digest").agg(F.min(F.struct("id", "text_hash")).alias("rep"), F.first("signature").alias("signature"))
    first = first.select("digest", F.col("rep.id").alias("rep"), F.col("rep.text_hash").alias("text_hash"), "signature")
    order = ["rep", "text_hash", "digest"]
    # Ranges ascend with the partitions' numbers, so that the smallest class of a component has its smallest id.
    numbered = first.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("class", F.monotonically_increasing_id())
    classes = storage.stored(numbered, "near-classes")

    n_classes = classes.count()
    # Tables that the result doesn't read; they are deleted at the end.
    done: list[storage.Stored] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        done.append(storage.Stored(df, name))
        return done[-1].df

    pairs = keep(storage.in_few_files(candidates(classes, keep), 2 * TREES * n_classes), "near-pairs")
    n_pairs = pairs.count()
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("degree"))
    clusters = connected_components(pairs).select(F.col("node").alias("class"), F.col("component").alias("cluster"))
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > CHUNK)
    chunks = F.coalesce(F.ceil(F.col("size") / CHUNK), F.lit(1)).cast("int")
    member = _salted(clusters, "class").join(_spread(sizes), ["cluster", "salt"], "left").select("class", "cluster", chunks.alias("chunks"))
    member = member.withColumn("chunk", F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int"))
    wanted = classes.select("class", F.col("rep").alias("id"), "text_hash").join(member, "class")
    chosen = base.join(wanted, ["id", "text_hash"]).select(F.col("class").alias("id"), "text", "cluster", "chunks", "chunk")
    sets = keep(chosen.mapInArrow(_sets(n_words), "id long, cluster long, chunks int, chunk int, shingles binary"), "near-sets")

    keys = ["cluster", "chunk"]
    dealt = sets.select(*keys, "id", "shingles")
    several = not sizes.isEmpty()
    if several:
        hubs = sets.join(_hubs(member.where("chunks > 1"), classes, ends), "id", "left_semi")
        dealt = dealt.unionByName(hubs.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(*keys, "id", "shingles"))
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys)
    linked = dealt.mapInArrow(_link(percent, keys), "a long, b long").unionByName(_same_id(full.where(F.col("id") < last), classes))
    linked = keep(storage.in_few_files(linked, n_pairs), "near-links")
    parts = connected_components(linked).select(F.col("node").alias("id"), F.col("component").alias("part"))

    # What is outside the main part of a cluster of several chunks is compared with all of the cluster, in blocks.
    rest = None
    if several:
        spread = sets.where("chunks > 1").select("id", "cluster", "chunks", "chunk").join(parts, "id", "left").withColumn("part", F.coalesce("part", "id"))
        by_part = spread.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("n"))
        main = by_part.groupBy("cluster").agg(F.max(F.struct("n", "part")).alias("main"), F.sum("n").alias("size"))
        rest = main.where("main.n < size").select("cluster", F.col("main.part").alias("main"), F.ceil((F.col("size") - F.col("main.n")) / CHUNK).cast("int").alias("blocks"))
        rest = keep(storage.in_few_files(_salted(spread, "id").join(_spread(rest), ["cluster", "salt"]).drop("salt"), n_classes), "near-rest")
    if rest is not None and not rest.isEmpty():
        placed = rest.select("id", "part", "main", "blocks").join(sets, "id")
        block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        outside = placed.where("part <> main").withColumn("block", block).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        inside = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        keys = ["cluster", "block", "chunk"]
        units = outside.withColumn("only", F.lit(True)).unionByName(inside.withColumn("only", F.lit(False)))
        units = units.groupBy(*keys, "id").agg(F.first("part").alias("part"), F.max("only").alias("only"), F.first("shingles").alias("shingles"))
        units = units.repartition(*keys).sortWithinPartitions(*keys)
        more = units.mapInArrow(_link(percent, keys), "a long, b long")
        linked = keep(storage.in_few_files(linked.unionByName(more), 2 * n_pairs), "near-links")
        parts = connected_components(linked).select(F.col("node").alias("id"), F.col("component").alias("part"))
    for table in done:
        table.drop()

    root = F.coalesce("part", "class")
    tops = classes.select(F.col("class").alias("root"), F.col("rep").alias("component"), F.col("text_hash").alias("top_hash"))
    reps = classes.select("digest", "class").join(parts.withColumnRenamed("id", "class"), "class", "left").select("digest", "class", root.alias("root")).join(tops, "root")
    out = signed.select("id", "text_hash", "n", "digest").join(reps, "digest", "left")
    component = F.coalesce("component", "id")
    given = lambda c: F.when(c < last, c)
    # Without an id, the smallest text hash of the smallest class is kept.
    nameless = (F.col("class") == F.col("root")) & (F.col("text_hash") == F.col("top_hash"))
    kept = F.when(F.col("digest").isNotNull() & (F.col("component") == last), nameless).otherwise(F.col("id") == component)
    columns = [given(F.col("id")).alias(id_col), F.col("n").alias("n_shingles"), given(component).alias("component_id"), kept.alias("kept")]
    return out.select(*columns, *(["text_hash"] if hashed else []))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: near duplicates of all documents on two-word shingles at a similarity of 0.8."""
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), n_words=2)
