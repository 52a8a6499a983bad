"""Removal of repeated word windows by super-k-mer partitioning.

A window is a run of consecutive words of one document. Its minimiser is the smallest hash of the short word groups
in it; consecutive windows with the same minimiser travel as one packed string to the minimiser's bucket. There the
hashes of all windows are sorted, equal ones are compared byte by byte, and all but the earliest are marked. Marks go
back to their documents as spans of words.

Only super-k-mers whose minimiser occurs at another place travel: a pass over all documents notes where each
super-k-mer lies (no text), and minimisers that occur once in all are left out, as no window of theirs can repeat.

Hot groups: within a block of documents equal packed strings are noted once, the others are marked at once, so that
copies cost one row a block. Windows of minimisers that still occur at very many places (a passage in many contexts or
blocks) are packed one by one. The earliest place of each is a minimum, aggregated before the shuffle, and is joined
back to the windows by their text, over salts, so that no task meets all places of a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweft import storage
from gridweft.llm import tokens

#: Words in a minimiser: enough that common phrases don't recur as minimisers.
GROUP_WORDS = 5
#: Text and packed strings that are worked on at once.
BLOCK_BYTES = 1 << 21
#: Places from which on a minimiser's windows travel one by one; so many strings are some 10 MB of a task.
HOT_ROWS = 50_000
#: Packed strings that are made at once.
SLICE = 50_000
#: Shares of the places of a hot window that are judged apart.
SALTS = 32

_MIX = np.uint64(0x9FB21C651E98DF25)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for each i."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows of ``width`` words that begin at each place, by doubling."""
    out, have, part, size = None, 0, h, 1
    bits = width
    while bits:
        if bits & 1:
            if out is None:
                out, have = part, size
            else:
                n = min(len(out), max(0, len(part) - have))
                out, have = tokens.mixed(out[:n] * _MIX + part[have : have + n]), have + size
        bits >>= 1
        if bits:
            n = max(0, len(part) - size)
            part, size = tokens.mixed(part[:n] * _MIX + part[size : size + n]), 2 * size
    return out


def _runs(words: tokens.Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Super-k-mers of a block: (minimiser, first window, last window, whether the minimiser lies in it twice).

    Windows are known by the places of their first words.
    """
    places = tokens.whole_grams(words.first, width)
    if not len(places):
        return np.zeros(0, np.uint64), places, places, np.zeros(0, bool)
    size = min(GROUP_WORDS, width)
    groups = tokens.ngrams(words.hashes(), size)
    key = _sliding_min(groups, width - size + 1)[places]
    new = np.ones(len(places), bool)
    new[1:] = (key[1:] != key[:-1]) | (places[1:] != places[:-1] + 1)
    begin = np.flatnonzero(new)
    first, last, key = places[begin], places[np.append(begin[1:], len(places)) - 1], key[begin]
    left, right = np.full(len(key), -1), np.zeros(len(key), np.int64)
    for j in range(width - size + 1):
        left = np.where((left < 0) & (groups[first + j] == key), first + j, left)
        right = np.where(groups[last + j] == key, last + j, right)
    return key, first, last, left != right


def _packed(words: tokens.Words, first: np.ndarray, last: np.ndarray, width: int) -> pa.Array:
    """The words of runs of windows, joined by one space."""
    joined, begin = words.joined()
    data = joined.tobytes()
    return pa.array([data[s:e] for s, e in zip(begin[first].tolist(), (begin[last + width] - 1).tolist(), strict=True)], pa.binary())


def _note(width: int):
    """Where the super-k-mers of a block lie: (key, id, text_hash, begin, windows, twice); key null for marked spans."""
    names = ["key", "id", "text_hash", "begin", "windows", "twice"]

    def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text_hash = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for row, data, offsets in tokens.text_blocks(batch.column(2), BLOCK_BYTES):
                words = tokens.Words(data, offsets)
                key, first, last, twice = _runs(words, width)
                if not len(key):
                    continue
                doc = np.searchsorted(words.first, first, "right") - 1
                begin = first - words.first[doc]
                own = ids[row + doc]
                order = np.lexsort((begin, own))
                code = _packed(words, first[order], last[order], width).dictionary_encode().indices.to_numpy()
                own, begin, doc, key, twice, windows = own[order], begin[order], doc[order], key[order], twice[order], (last - first)[order] + 1
                is_first = code > np.append(-1, np.maximum.accumulate(code)[:-1])
                # The earliest of equal strings; rows that begin at the same place of the same id are not later than it.
                earliest = np.flatnonzero(is_first)[code]
                later = (own != own[earliest]) | (begin != begin[earliest])
                keys = pa.array(key.view(np.int64), mask=later)
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(x) for x in (own, text_hash[row + doc], begin.astype(np.int32), windows.astype(np.int32), twice))], names=names)

    return note


def _send(width: int, one_by_one: bool):
    """Packed strings of the listed super-k-mers of each document, or of their windows one by one.

    The key of a super-k-mer is its minimiser, that of a window by itself the hash of its words.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text_hash = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for row, data, offsets in tokens.text_blocks(batch.column(2), BLOCK_BYTES):
                n = len(offsets) - 1
                words = tokens.Words(data, offsets)
                lists = batch.column(3).slice(row, n)
                flat = lists.flatten()
                begin, windows = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("begin", "windows"))
                doc = np.repeat(np.arange(n), lists.value_lengths().to_numpy())
                if not len(begin):
                    continue
                hashes = words.hashes()
                if one_by_one:
                    nth = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
                    doc, begin = np.repeat(doc, windows), np.repeat(begin, windows) + nth
                    start = last = words.first[doc] + begin
                    key = _window_hashes(hashes, width)[start]
                else:
                    start = words.first[doc] + begin
                    last = start + windows - 1
                    size = min(GROUP_WORDS, width)
                    key = _sliding_min(tokens.ngrams(hashes, size), width - size + 1)[start]
                # In slices, as windows one by one overlap and so repeat their words.
                for at in range(0, len(start), SLICE):
                    own = slice(at, at + SLICE)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[own].view(np.int64)), _packed(words, start[own], last[own], width).cast(pa.string()), *(pa.array(x) for x in (ids[row + doc[own]], text_hash[row + doc[own]], begin[own].astype(np.int32)))],
                        names=["key", "packed", "id", "text_hash", "begin"],
                    )

    return send


def _marked(table: pa.Table, width: int) -> pa.RecordBatch:
    """Spans of windows of a bucket that start earlier elsewhere."""
    ids, text_hash, start = (table.column(x).to_numpy() for x in ("id", "text_hash", "begin"))
    start = start.astype(np.int64)
    out: list[tuple] = []
    for row, data, offsets in tokens.text_blocks(table.column("packed"), 1 << 60):
        words = tokens.Words(data, offsets)
        places = tokens.whole_grams(words.first, width)
        h = _window_hashes(words.hashes(), width)[places]
        order = np.argsort(h)
        ranked = h[order]
        same = ranked[1:] == ranked[:-1]
        twin = np.zeros(len(h), bool)
        twin[1:] |= same
        twin[:-1] |= same
        found = order[twin]
        if not len(found):
            continue
        place = places[found]
        run = np.searchsorted(words.first, place, "right") - 1
        own, begin = ids[row + run], start[row + run] + place - words.first[run]
        by = np.lexsort((begin, own, h[found]))
        place, run, own, begin, hashed = place[by], run[by], own[by], begin[by], h[found][by]
        text = data.tobytes()
        group = np.cumsum(np.append(True, hashed[1:] != hashed[:-1])) - 1
        lead = np.flatnonzero(np.append(True, group[1:] != group[:-1]))[group]
        s, e = words.start[place].tolist(), words.end[place + width - 1].tolist()
        if not all(text[s[i] : e[i]] == text[s[k] : e[k]] for i, k in enumerate(lead.tolist()) if i != k):
            first_of: dict[bytes, int] = {}  # two texts share a hash: group by the texts themselves
            lead = np.array([first_of.setdefault(text[a:b], i) for i, (a, b) in enumerate(zip(s, e, strict=True))])
        later = (own != own[lead]) | (begin != begin[lead])
        place, run = place[later], run[later]
        if not len(place):
            continue
        order = np.argsort(place)
        place, run = place[order], run[order]
        new = np.append(True, (place[1:] != place[:-1] + 1) | (run[1:] != run[:-1]))
        at = np.flatnonzero(new)
        to = np.append(at[1:], len(place)) - 1
        base = start[row + run[at]] - words.first[run[at]]
        out.append((ids[row + run[at]], text_hash[row + run[at]], base + place[at], base + place[to] + width))
    columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)).cast(k) for x, k in zip(columns, kinds, strict=True)], names=["id", "text_hash", "begin", "end"])


def _bucket(width: int):
    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held.append(table)
            size += table.nbytes
            if size >= 4 * BLOCK_BYTES:
                whole = pa.concat_tables(held).combine_chunks()
                key = whole.column("key").to_numpy()
                cut = int(np.searchsorted(key, key[-1], "left"))  # the last key may go on in the next batch
                for part in _by_keys(whole.slice(0, cut), key[:cut]):
                    yield _marked(part, width)
                held = [whole.slice(cut)]
                size = held[0].nbytes
        if held:
            whole = pa.concat_tables(held).combine_chunks()
            for part in _by_keys(whole, whole.column("key").to_numpy()):
                yield _marked(part, width)

    return bucket


def _by_keys(table: pa.Table, key: np.ndarray) -> Iterator[pa.Table]:
    """Parts of whole keys, of about BLOCK_BYTES."""
    rows = max(1, int(len(key) * BLOCK_BYTES / max(1, table.nbytes)))
    at = 0
    while at < len(key):
        to = int(np.searchsorted(key, key[min(at + rows, len(key)) - 1], "right"))
        yield table.slice(at, to - at)
        at = to


def _keep(width: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begins, ends = (batch.column(k) for k in (2, 3))
            for row, data, offsets in tokens.text_blocks(batch.column(1), BLOCK_BYTES):
                n = len(offsets) - 1
                words = tokens.Words(data, offsets)
                joined, at = words.joined()
                own_begins, own_ends = begins.slice(row, n), ends.slice(row, n)
                count = np.where(own_begins.is_valid(), own_begins.value_lengths().fill_null(0), 0)
                base = np.repeat(words.first[:-1], count)
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, base + own_begins.flatten().to_numpy(), 1)
                np.add.at(edge, base + own_ends.flatten().to_numpy(), -1)
                gone = np.cumsum(edge[:-1]) > 0
                left = joined[np.repeat(~gone, np.diff(at))].tobytes()
                size = np.concatenate([[0], np.cumsum(np.where(gone, 0, np.diff(at)))])[words.first]
                removed = np.concatenate([[0], np.cumsum(gone)])[words.first]
                texts = [left[s : max(s, e - 1)] for s, e in zip(size[:-1].tolist(), size[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n), pa.array(words.counts, pa.int64()), pa.array(np.diff(removed), pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())],
                    names=["id", "n_words", "n_removed", "kept_text"],
                )

    return keep


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20) -> DataFrame:
    """Texts without the words of windows that start earlier: (id_col, n_words, n_removed, kept_text), one row per row.

    A window of ``width`` consecutive words of one document is marked when its word sequence also starts in a smaller
    id, or earlier in the same document; every word that a marked window covers goes, and the others are joined by one
    space. Windows are judged on the input. Null and empty texts have no words; texts under ``width`` words have no
    windows. Rows repeated with the same id start at the same places and so don't remove each other; rows of one id
    with other texts are kept apart. A null id is larger than all others. Other columns are not read. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    last = 2**63 - 1
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(last)).alias("id"), F.col(id_col).cast("long").alias("given"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Tells rows of one id apart by their texts; two of them are mixed up where 64 bits agree.
    base = base.withColumn("text_hash", F.xxhash64("text", F.octet_length("text")))
    noted = storage.stored(base.select("id", "text_hash", "text").mapInArrow(_note(width), "key long, id long, text_hash long, begin int, windows int, twice boolean"), "repeats-noted")
    counts = noted.where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("twice")).where("n > 1 OR twice")
    counts = storage.stored(counts.select("key", (F.col("n") > HOT_ROWS).alias("hot")), "repeats-counts")
    found = noted.join(counts, "key").select("id", "text_hash", "hot", F.struct("begin", "windows").alias("run"))
    schema = "key long, packed string, id long, text_hash long, begin int"

    def sent(hot: bool) -> DataFrame:
        # Of one document there are at most as many runs, and as many spans, as it has words.
        runs = found.where(F.col("hot") == hot).groupBy("id", "text_hash").agg(F.collect_list("run").alias("runs"))
        # ``given`` is carried so that all joins read one exchange of the texts.
        return base.join(runs, ["id", "text_hash"]).select("id", "text_hash", "text", "runs", "given").mapInArrow(_send(width, hot), schema)

    dealt = sent(False).repartition("key").sortWithinPartitions("key")
    spans = dealt.mapInArrow(_bucket(width), "id long, text_hash long, begin int, end int")
    if not counts.where("hot").isEmpty():
        windows = storage.stored(sent(True), "repeats-hot")
        place = F.struct("id", "begin")
        first = windows.groupBy("key", "packed").agg(F.min(place).alias("first")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = windows.withColumn("salt", F.pmod(F.xxhash64("id", "begin"), F.lit(SALTS)).cast("int"))
        later = salted.join(first, ["key", "packed", "salt"]).where(place != F.col("first"))
        spans = spans.unionByName(later.select("id", "text_hash", "begin", (F.col("begin") + width).alias("end")))
    spans = spans.unionByName(noted.where("key IS NULL").select("id", "text_hash", "begin", (F.col("begin") + F.col("windows") + width - 1).alias("end")))
    # Repeated rows send the same spans.
    listed = spans.distinct().groupBy("id", "text_hash").agg(F.collect_list("begin").alias("begins"), F.collect_list("end").alias("ends"))
    joined = base.join(listed, ["id", "text_hash"], "left").select("given", "text", "begins", "ends")
    return joined.mapInArrow(_keep(width), "id long, n_words long, n_removed long, kept_text string").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: all documents without repeated windows of 20 words."""
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents
), v AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE len(ws) >= 20
), later AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i:i + 19], ' ') ORDER BY doc_id, i) AS nth FROM v
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later WHERE nth > 1
), w AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d
), k AS (
  SELECT w.doc_id, string_agg(w.w, ' ' ORDER BY w.i) FILTER (WHERE gone.i IS NULL) AS kept, count(gone.i) AS n_removed
  FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id AND w.i = gone.i GROUP BY w.doc_id
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
