"""Packing documents into sequences by a configuration linear program over the length histogram.

Documents are tokenised once; the pieces (length, checksum) are written. The histogram of lengths, of at most
``capacity`` rows whatever the input, goes to the driver. There the program "fewest sequences whose configurations
cover every length's count" is solved by multiplicative weights: each round prices the lengths, a knapsack dynamic
program finds for each of the least covered lengths the configuration of the highest price, and lengths that these
cover become cheaper; prices also bound the program from below, and rounds end where that bound is near. The solution
is rounded down, and what is left is packed best-fit by groups of equal bins. The plan says which sequence and place the k-th
piece of a length gets; pieces are numbered within their length, large lengths over salts, and look it up.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridweft import storage
from gridweft.llm import tokens

#: Pieces of one length that are numbered in one task.
ROWS_A_SALT = 50_000
#: Rounds of multiplicative weights, at most; how close to its bound the program need come, and the rate at which
#: covered lengths become cheaper.
ROUNDS, GAP, RATE = 600, 0.002, 0.5
#: Lengths that a round covers, each with its best configuration, and the part of what fits that one step adds.
LEAST_COVERED, STEP = 200, 0.25
#: Distinct word parts whose ids a worker remembers, at most twice over.
CACHE_PARTS = 200_000

_LETTER, _DIGIT, _SIGN, _OTHER = 1, 2, 3, 4
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[:128] = _SIGN
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[48:58] = _DIGIT


def _byte_classes(data: np.ndarray) -> np.ndarray:
    """Letters are A-Z, a-z and U+00C0 to U+017F without the two signs and the one letter that grows in lower case."""
    kind = _CLASS[data]
    lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC5))
    code = (data[lead].astype(np.int64) & 31) << 6 | data[lead + 1] & 63
    lead = lead[(code >= 0xC0) & (code != 0xD7) & (code != 0xF7) & (code != 0x130)]
    kind[lead] = kind[lead + 1] = _LETTER
    return kind


def _byte_units() -> dict[int, str]:
    """The characters that stand for bytes: visible ones for themselves, the others, ascending, from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


#: How a tokenizer prepares and splits texts whose parts can be looked up one by one.
BY_PARTS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Text whose parts are looked up at once; more text has fewer parts that differ.
BLOCK_BYTES = 1 << 21
#: Texts that a tokenizer of another kind gets at once.
TEXTS = 256


class PartEncoder:
    """Token ids of texts. With a tokenizer as in BY_PARTS they are looked up by parts that its splitting never joins.

    A tokenizer of another kind gets whole texts.

    A word is cut between two plain characters of different kinds, and between digits; words with an apostrophe, a bar
    or a capital sigma, whose splitting depends on what follows, are left whole. Parts of plain letters go to the
    tokenizer's model, all others through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        prepared = json.loads(self.tokenizer.to_str())
        self.by_parts = all(prepared[k] == v for k, v in BY_PARTS.items())
        self.units = _byte_units()
        self.young: dict[bytes, list[int]] = {}
        self.old: dict[bytes, list[int]] = {}

    def part_ids(self, parts: list[bytes]) -> list[list[int]]:
        """Ids of each part."""
        if len(self.young) > CACHE_PARTS:
            self.young, self.old = {}, self.young
        found: list[list[int] | None] = []
        whole: list[int] = []
        for i, part in enumerate(parts):
            ids = self.young.get(part)
            if ids is None:
                ids = self.old.get(part)
                if ids is None:
                    text = part.decode()
                    if text.isascii() and text.isalpha():
                        ids = [t.id for t in self.model.tokenize(text.lower())]
                    elif text.isalpha() and max(text) < "ƀ" and "İ" not in text:
                        units = text.lower().encode().decode("latin-1").translate(self.units)
                        ids = [t.id for t in self.model.tokenize(units)]
                    else:
                        whole.append(i)
                        found.append(None)
                        continue
                self.young[part] = ids
            found.append(ids)
        if whole:
            for i, e in zip(whole, self.tokenizer.encode_batch_fast([parts[i].decode() for i in whole], add_special_tokens=False)):
                found[i] = self.young[parts[i]] = e.ids
        return found

    def encode_whole(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """encode() through the whole tokenizer."""
        for first in range(0, len(column), TEXTS):
            texts = [t or "" for t in column.slice(first, TEXTS).to_pylist()]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            yield first, np.fromiter(chain.from_iterable(ids), np.uint32), np.cumsum([0, *map(len, ids)])

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, offsets) of blocks of rows of a string column, without special tokens."""
        if not self.by_parts:
            yield from self.encode_whole(column)
            return
        for first, data, offsets in tokens.text_blocks(column, BLOCK_BYTES):
            data = tokens.lowered(data)
            words = tokens.Words(data, offsets)
            kind = _byte_classes(data)
            cut = np.zeros(len(data), bool)
            a, b = kind[:-1], kind[1:]
            cut[1:] = ((a != b) & (a != _OTHER) & (b != _OTHER)) | ((a == _DIGIT) & (b == _DIGIT))
            odd = np.zeros(len(data) + 1, np.int32)
            np.cumsum((data == 0x27) | (data == 0x7C) | (data == 0xCE), out=odd[1:])
            odd_words = odd[words.end] > odd[words.start]
            # A cut counts between the start and the end of a word that isn't odd; starts are ends of no other word.
            edge = np.zeros(len(data) + 1, np.int8)
            edge[words.start[~odd_words] + 1] = 1
            edge[words.end[~odd_words]] -= 1
            cut &= np.cumsum(edge[:-1], dtype=np.int8) > 0
            begins, ends = cut.copy(), cut
            begins[words.start] = True
            ends = np.append(ends, False)
            ends[words.end] = True
            start, end = np.flatnonzero(begins), np.flatnonzero(ends)
            size = end - start
            begin = np.zeros(len(start) + 1, np.int64)
            np.cumsum(size, out=begin[1:])
            packed, _ = words.joined(b"")
            parts = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(begin), pa.py_buffer(packed)])
            coded = parts.dictionary_encode()
            ids = self.part_ids(coded.dictionary.to_pylist())
            place = coded.indices.to_numpy(zero_copy_only=False)
            count = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(count.sum()))
            at = np.concatenate([[0], np.cumsum(count)])[:-1]
            each = count[place]
            upto = np.concatenate([[0], np.cumsum(each)])
            out = flat[np.repeat(at[place] - upto[:-1], each) + np.arange(upto[-1])]
            yield first, out, upto[np.searchsorted(start, offsets)]


_encoders: dict[str, PartEncoder] = {}


def _encoder(path: str) -> PartEncoder:
    if path not in _encoders:
        _encoders[path] = PartEncoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: id, piece, start, length, ids_crc32. Each document is its ids and ``end_id``; null is empty."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            for first, ids, offsets in encoder.encode(batch.column(1)):
                doc, number, start, length, crc = [], [], [], [], []
                for i in range(len(offsets) - 1):
                    own = np.append(ids[offsets[i] : offsets[i + 1]], np.uint32(end_id)).astype("<u4")
                    for k, at in enumerate(range(0, len(own), capacity)):
                        part = own[at : at + capacity]
                        doc.append(first + i)
                        number.append(k)
                        start.append(at)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                columns = [batch.column(0).take(pa.array(doc, pa.int64())), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "piece", "start", "length", "ids_crc32"])

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(cut, "id long, piece int, start long, length long, ids_crc32 long")


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For every room up to ``capacity`` the highest total price that fits, and the first length of it (0: leave one place)."""
    by_size = np.full(capacity + 1, -1.0)
    by_size[lengths] = prices
    best = np.zeros(capacity + 1)
    pick = np.zeros(capacity + 1, np.int64)
    for room in range(int(lengths[0]), capacity + 1):
        worth = by_size[1 : room + 1] + best[room - 1 :: -1] if room > 1 else by_size[1:2] + best[:1]
        at = int(worth.argmax())
        if worth[at] > best[room - 1]:
            best[room], pick[room] = worth[at], at + 1
        else:
            best[room] = best[room - 1]
    return best, pick


def configuration(pick: np.ndarray, first: int, limits: dict[int, int], capacity: int) -> dict[int, int]:
    """The configuration of the highest price that holds a length, no length above its limit."""
    found: dict[int, int] = defaultdict(int)
    found[first], room = 1, capacity - first
    while room > 0:
        size = int(pick[room])
        if size:
            found[size] += 1
        room -= size or 1
    return {size: min(n, limits[size]) for size, n in found.items()}


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """Configurations (length -> copies) with how often each is used; together they hold every piece exactly once."""
    order = np.argsort(lengths)
    lengths, counts = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    if not len(lengths):
        return []
    left = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
    chosen: list[tuple[dict[int, int], int]] = []

    def take(items: dict[int, int], times: int) -> None:
        if times > 0:
            chosen.append((items, times))
            for size, n in items.items():
                left[size] -= n * times

    place = {size: i for i, size in enumerate(lengths.tolist())}
    covered, used = np.zeros(len(lengths)), 0.0
    bound = float((lengths * counts).sum()) / capacity
    found: dict[tuple, float] = defaultdict(float)
    for _ in range(rounds):
        prices = lengths * np.exp(-RATE * (covered - covered.min()))
        best, pick = knapsack(lengths, prices, capacity)
        # Prices over the best configuration's are a solution of the dual program, and so a lower bound.
        bound = max(bound, float((prices * counts).sum()) / best[capacity])
        if covered.min() > 0 and used / covered.min() <= (1 + GAP) * bound:
            break
        for i in np.argsort(covered, kind="stable")[:LEAST_COVERED].tolist():
            one = configuration(pick, int(lengths[i]), left, capacity)
            step = STEP * min(left[size] / n for size, n in one.items())
            found[tuple(sorted(one.items()))] += step
            used += step
            for size, n in one.items():
                covered[place[size]] += n * step / left[size]
    # Scaled so that the length that is covered least is covered once; lengths that are covered more often run out.
    once = max(float(covered.min()), 1e-9)
    for items, x in sorted(found.items(), key=lambda c: (-sum(s * n for s, n in c[0]), -c[1], c[0])):
        fit = min(left[size] // n for size, n in items)
        # A configuration with a hole is left to the rest, as its room can be filled there.
        if sum(s * n for s, n in items) == capacity or len(lengths) == 1:
            take(dict(items), min(int(x / once), fit))
    # What rounding leaves: the widest first, each into the fullest bins that have room; equal bins stay one group.
    groups: dict[int, list[tuple[tuple, int]]] = defaultdict(list)
    rest = {size: n for size, n in left.items() if n}
    for size in sorted(rest, reverse=True):
        n = rest[size]
        for room in sorted(r for r in groups if r >= size and groups[r]):
            fits = room // size
            kept = []
            for held, bins in groups[room]:
                full = min(bins, n // fits)
                if full:
                    groups[room - fits * size].append((held + ((size, fits),), full))
                    n -= full * fits
                    bins -= full
                if bins and n:
                    groups[room - n * size].append((held + ((size, n),), 1))
                    n, bins = 0, bins - 1
                if bins:
                    kept.append((held, bins))
            groups[room] = kept
            if not n:
                break
        if n:
            fits = capacity // size
            if n // fits:
                groups[capacity - fits * size].append((((size, fits),), n // fits))
            if n % fits:
                groups[capacity - n % fits * size].append((((size, n % fits),), 1))
    for room in sorted(groups):
        for held, bins in groups[room]:
            chosen.append((dict(held), bins))
    return chosen


def slots(chosen: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """Where the k-th piece of a length goes, as runs: from k, copies of the length in a sequence, first sequence, offset."""
    rows, used, base = [], defaultdict(int), 0
    for configuration, times in chosen:
        offset = 0
        for size in sorted(configuration, reverse=True):
            n = configuration[size]
            rows.append((size, used[size], n, base, offset))
            used[size] += n * times
            offset += n * size
        base += times
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "from_k", "copies", "sequence", "offset"), columns, strict=True))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Pieces of all documents with their place: (id_col, piece, start, length, ids_crc32, sequence_id, offset).

    Null and empty texts are documents of the end id alone. Documents above ``capacity`` are cut, others never. Rows
    repeated with the same id are documents of their own; ties are ordered by id, piece and checksum, so that reruns
    agree. A null id is kept. Other columns are not read. An empty table gives no rows. The driver holds the length
    histogram (``capacity`` rows at most) and the plan, whose size depends on ``capacity`` and ``rounds`` alone.
    """
    spark = docs.sparkSession
    found = storage.stored(pieces(docs, tokenizer, capacity, id_col=id_col, text_col=text_col), "pack-pieces")
    histogram = found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).toPandas()
    runs = spark.sparkContext.broadcast(slots(plan(histogram["length"].to_numpy(), histogram["n"].to_numpy(), capacity, rounds)))
    salts = int(-(-int(histogram["n"].max()) // ROWS_A_SALT)) if len(histogram) else 1
    salted = found.withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(salts)).cast("int"))
    inside = Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")
    numbered = salted.withColumn("k", F.row_number().over(inside).cast("long") - 1)
    if salts > 1:
        before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
        counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
        starts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from"))
        numbered = numbered.join(starts, ["length", "salt"]).withColumn("k", F.col("k") + F.col("from"))
    names = ["id", "piece", "start", "length", "ids_crc32"]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = runs.value
        for batch in batches:
            length, k = (batch.column(name).to_numpy() for name in ("length", "k"))
            # One sorted key for both: counts of a length stay below 2**48.
            at = np.searchsorted((table["length"] << 48) + table["from_k"], (length << 48) + k, "right") - 1
            n = k - table["from_k"][at]
            copies = table["copies"][at]
            sequence, offset = table["sequence"][at] + n // copies, table["offset"][at] + n % copies * length
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    out = numbered.select(*names, "k").mapInArrow(placed, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: all documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
