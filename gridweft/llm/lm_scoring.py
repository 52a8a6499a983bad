"""Stupid-backoff language-model scores of all documents against the counts of all documents.

Runs of documents are chunks, known by their contents. Each chunk explodes its n-grams of every order, counts equal
ones and deals them to the count tables, one for each order, by ranges of their hashes. A range is a part: the table
(hash, count) of all chunks, sorted and summed; its size follows from the input's, not from the session. The part is
joined with the n-grams that asked for it, and the totals go back to the chunks, which join them to their words and sum
scores per document.

On the way rows are columns in blobs: sorted hashes as differences, in byte planes, compressed; totals in the order of
the hashes. A chunk travels compressed to meet its totals. An n-gram is known by a 64-bit hash of its words.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweft import storage
from gridweft.llm import tokens

#: Text in a chunk, text whose n-grams a part counts, and text behind the parts or chunks of a task.
CHUNK_BYTES, PART_BYTES, TASK_BYTES = 12 << 20, 8 << 20, 32 << 20


def _squeezed(x: np.ndarray) -> bytes:
    """Integers as their size, then all first bytes first, compressed."""
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def _unsqueezed(data: bytes, dtype: type) -> np.ndarray:
    planes = pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"))
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


class _Chunk:
    """The n-grams of a column of texts."""

    def __init__(self, column: pa.Array):
        hashes, first = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
        for _, data, offsets in tokens.text_blocks(column):
            words = tokens.Words(data, offsets)
            hashes.append(words.hashes())
            first.append(first[-1][-1] + words.first[1:])
        self.words, self.first = np.concatenate(hashes), np.concatenate(first)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams, and the place of each one's last word."""
        at = tokens.whole_grams(self.first, n)
        return tokens.ngrams(self.words, n)[at] if n > 1 else self.words, at + n - 1


def _cuts(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Where the equal ranges of the hash space begin and end in sorted hashes."""
    edges = np.array([(i << 64) // parts for i in range(parts)], np.uint64)
    return np.append(np.searchsorted(hashes, edges), len(hashes))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(name, rows of id and text) of runs of rows of at most about CHUNK_BYTES; a name is a hash of ids and texts."""
    for batch in batches:
        size = sum(len(data) for _, data, _ in tokens.text_blocks(batch.column(1)))
        for row, data, offsets in tokens.text_blocks(batch.column(1), -(-size // max(1, -(-size // CHUNK_BYTES)))):
            rows = batch.slice(row, len(offsets) - 1)
            seen = hashlib.blake2b(data, digest_size=8)
            seen.update(offsets)
            seen.update(repr(rows.column(0).to_pylist()).encode())
            yield int.from_bytes(seen.digest(), "little", signed=True), rows


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, rows): each chunk as compressed bytes."""
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))
    for name, rows in _chunks(batches):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=options) as writer:
            writer.write_batch(rows)
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "rows"])


def _ask(order: int, parts: int):
    """(n, part, chunk, grams, counts): the n-grams of a chunk in a part's range of hashes."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, rows in _chunks(batches):
            chunk = _Chunk(rows.column(1))
            for n in range(1, order + 1):
                hashes, counts = np.unique(chunk.grams(n)[0], return_counts=True)
                cuts, counts = _cuts(hashes, parts), counts.astype(np.uint32)
                full = np.flatnonzero(np.diff(cuts)).tolist()
                grams = [_squeezed(np.diff(hashes[cuts[p] : cuts[p + 1]], prepend=np.uint64(0))) for p in full]
                times = [_squeezed(counts[cuts[p] : cuts[p + 1]]) for p in full]
                keys = [pa.array([n] * len(full), pa.int32()), pa.array(full, pa.int64()), pa.array([name] * len(full), pa.int64())]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(grams, pa.binary()), pa.array(times, pa.binary())], names=["n", "part", "chunk", "grams", "counts"])

    return ask


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, n, part, totals) for every row that asked; rows come sorted by n and part, one part is held at a time."""
    held: list[tuple] = []
    last = None

    def answers() -> Iterator[pa.RecordBatch]:
        grams = [np.cumsum(_unsqueezed(x[1], np.uint64), dtype=np.uint64) for x in held]
        cuts = np.cumsum([len(g) for g in grams])[:-1]
        flat = np.concatenate(grams)
        del grams
        by = np.argsort(flat, kind="stable")
        flat = flat[by]
        first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
        size = np.diff(np.append(first, len(flat)))
        del flat
        sums = np.add.reduceat(np.concatenate([_unsqueezed(x[2], np.uint32) for x in held])[by], first, dtype=np.int64)
        totals = np.empty(len(by), np.int64)
        totals[by] = np.repeat(sums, size)
        blobs = [_squeezed(x) for x in np.split(totals, cuts)]
        n, part = last
        columns = [pa.array([x[0] for x in held], pa.int64()), pa.array([n] * len(held), pa.int32()), pa.array([part] * len(held), pa.int64()), pa.array(blobs, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["chunk", "n", "part", "totals"])

    for batch in batches:
        for n, part, chunk, grams, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (n, part) != last:
                if held:
                    yield from answers()
                held, last = [], (n, part)
            held.append((chunk, grams, counts))
    if held:
        yield from answers()


def _score(order: int, alpha: float, least: int):
    def score(key: tuple, chunks: pa.Table, answers: pa.Table) -> pa.Table:
        # Chunks of equal contents have one name and equal answers.
        given: dict[int, dict[int, bytes]] = {n: {} for n in range(1, order + 1)}
        for n, part, totals in zip(*(answers.column(c).to_pylist() for c in ("n", "part", "totals")), strict=True):
            given[n][part] = totals
        return pa.concat_tables([one(pa.ipc.open_stream(x).read_all(), given) for x in chunks.column("rows").to_pylist()])

    def one(table: pa.Table, given: dict[int, dict[int, bytes]]) -> pa.Table:
        column = table.column(1).combine_chunks()
        chunk = _Chunk(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column)
        counts = np.diff(chunk.first)
        total = len(chunk.words)
        best, depth = np.zeros(total), np.zeros(total, np.int8)
        before: np.ndarray | None = None
        for n in range(1, order + 1):
            hashes, at = chunk.grams(n)
            known, place = np.unique(hashes, return_inverse=True)
            totals = np.concatenate([np.zeros(0, np.int64), *(_unsqueezed(given[n][p], np.int64) for p in sorted(given[n]))])
            if len(totals) != len(known):
                raise RuntimeError("the rows of a chunk were read in another order the second time; store the input first")
            own = totals[place]
            if n == 1:
                best, depth = own.astype(np.float64), np.ones(total, np.int8)
            else:
                # The context is the (n-1)-gram that ends a word earlier; without enough counts the shorter score stays, times alpha.
                seen = own >= least
                best[at] = np.where(seen, own / np.maximum(before[at - 1], 1), alpha * best[at])
                depth[at] = np.where(seen, n, depth[at])
            before = np.zeros(total, np.int64)
            before[at] = own
        doc = np.repeat(np.arange(len(counts)), counts)
        sums = np.bincount(doc, weights=np.log(best), minlength=len(counts)).astype(np.float64)  # of no words, whole numbers
        columns = [table.column(0), pa.array(counts, pa.int64()), pa.array(sums)]
        columns += [pa.array(np.bincount(doc, weights=depth == n, minlength=len(counts)).astype(np.int64)) for n in range(1, order + 1)]
        return pa.table(columns, names=["id", "n_words", "log_score", *(f"n_order{n}" for n in range(1, order + 1))])

    return score


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, alpha: float = 0.4, least: int = 2) -> DataFrame:
    """Scores of all documents: (id_col, n_words, log_score, n_order1.., mean_log_score), one row per row of ``docs``.

    The score of a word is count(n-gram) / count(context) for the longest n-gram that ends with it, lies in its document
    and occurs ``least`` times or more in all documents, times ``alpha`` for every order skipped; a word by itself scores
    count / words in all. With ``least`` = 2 an n-gram that only the word itself shows doesn't count. log_score sums
    natural logarithms, n_orderN counts the words scored by order N, mean_log_score is null without words (null, empty
    and blank texts). Rows repeated with the same id are documents of their own, in the counts too. A null id is kept.
    Other columns are not read. An empty table gives no rows. ``docs`` is read twice and must give the same rows in the
    same order, as files do; what a shuffle gives is to be stored first.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    asked = base.mapInArrow(_ask(order, parts), "n int, part long, chunk long, grams binary, counts binary")
    dealt = asked.repartition(tasks, "n", "part").sortWithinPartitions("n", "part")
    totals = dealt.mapInArrow(_total, "chunk long, n int, part long, totals binary").repartition(tasks, "chunk")
    chunks = base.mapInArrow(_pack, "chunk long, rows binary").repartition(tasks, "chunk")
    schema = "id long, n_words long, log_score double, " + ", ".join(f"n_order{n} long" for n in range(1, order + 1))
    scored = storage.stored(chunks.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(_score(order, alpha, least), schema), "lm-scores")
    # Words that are scored by themselves still lack the number of all words as their denominator.
    words = scored.agg(F.sum("n_words")).first()[0] or 0
    log_score = F.col("log_score") - F.col("n_order1") * F.lit(math.log(max(words, 1)))
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return scored.withColumn("log_score", log_score).withColumn("mean_log_score", mean).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: trigram stupid-backoff scores of all documents."""
    found = lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_order1", "n_order2", "n_order3", F.round("mean_log_score", 6).alias("mean_log_score"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents
), w AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d
), g AS (
  SELECT doc_id, i, w,
         lag(w, 1) OVER (PARTITION BY doc_id ORDER BY i) AS w1, lag(w, 2) OVER (PARTITION BY doc_id ORDER BY i) AS w2 FROM w
), c AS (
  SELECT *, count(*) OVER (PARTITION BY w) AS c1, count(*) OVER () AS total,
         CASE WHEN w1 IS NOT NULL THEN count(*) OVER (PARTITION BY w1, w) END AS c2,
         CASE WHEN w2 IS NOT NULL THEN count(*) OVER (PARTITION BY w2, w1, w) END AS c3 FROM g
), p AS (
  SELECT *, lag(c1) OVER (PARTITION BY doc_id ORDER BY i) AS p1, lag(c2) OVER (PARTITION BY doc_id ORDER BY i) AS p2 FROM c
), s AS (
  SELECT doc_id,
         CASE WHEN c3 >= 2 THEN 3 WHEN c2 >= 2 THEN 2 ELSE 1 END AS depth,
         CASE WHEN c3 >= 2 THEN ln(c3 / p2)
              WHEN c2 >= 2 THEN ln((CASE WHEN c3 IS NULL THEN 1 ELSE 0.4::DOUBLE END) * (c2 / p1))
              ELSE ln((CASE WHEN c2 IS NULL THEN 1 WHEN c3 IS NULL THEN 0.4::DOUBLE ELSE 0.4::DOUBLE * 0.4::DOUBLE END) * (c1 / total)) END AS score FROM p
), t AS (
  SELECT doc_id, sum(score) AS score, count(*) AS n, count(*) FILTER (WHERE depth = 1) AS n1, count(*) FILTER (WHERE depth = 2) AS n2,
         count(*) FILTER (WHERE depth = 3) AS n3 FROM s GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(n1, 0)::BIGINT AS n_order1, coalesce(n2, 0)::BIGINT AS n_order2,
       coalesce(n3, 0)::BIGINT AS n_order3, round(score / n, 6) AS mean_log_score
FROM d LEFT JOIN t ON d.doc_id = t.doc_id
"""
