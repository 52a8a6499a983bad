"""Phrases whose words occur together more often than apart, per language.

The n-grams of all texts become rows (lang, phrase, n), summed within a block of text first, and are added up by hash
aggregation. This goes length by length: an n-gram reaches the least count only if both shorter ones in it do, so those
that can't are no rows. Which shorter ones do is a bitmap of hashes of at most MOST_BITS bits, whatever the input: a
collision lets a row through that the count then leaves out, and a full bitmap lets all through. Counts are by the
phrases themselves. Candidates meet the counts of their parts in joins, scores are decimals, phrases that a phrase of
one more word stands for leave by an anti-join, and a window ranks what is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridweft import storage
from gridweft.llm import tokens

#: Bits of the bitmap: for each phrase in it, and at most (8 MB).
BITS_A_PHRASE, MOST_BITS = 64, 1 << 26

_SPACE, _BREAK = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[0x20, 0x09]] = True
_BREAK[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _lang_hash(langs: pa.Array) -> np.ndarray:
    return tokens.mixed(np.array([zlib.crc32(x.encode()) + len(x) for x in langs.to_pylist()], np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class _Block:
    """The words of a block of texts in lower case, the pieces that they lie in, and the language of each word."""

    def __init__(self, langs: pa.Array, data: np.ndarray, offsets: np.ndarray):
        coded = langs.dictionary_encode()
        self.langs, lang = coded.dictionary, coded.indices.to_numpy()
        data = tokens.lowered(data)
        self.words = tokens.Words(data, offsets, _SPACE | _BREAK)
        self.lang = np.repeat(lang, self.words.counts)
        new = np.zeros(len(self.words), bool)
        new[self.words.first[:-1][self.words.counts > 0]] = True
        passed = np.cumsum(_BREAK[data])[self.words.start]
        new[1:] |= passed[1:] != passed[:-1]
        self.piece_first = np.append(np.flatnonzero(new), len(self.words))

    def places(self, n: int, bitmap: np.ndarray | None) -> np.ndarray:
        """Where n-grams begin of which, by the bitmap, both shorter ones may be frequent."""
        if not len(self.words):
            return np.zeros(0, np.int64)
        places = tokens.whole_grams(self.piece_first, n)
        if bitmap is None or not len(places):
            return places
        shorter = tokens.ngrams(self.words.hashes(), n - 1)
        salt = _lang_hash(self.langs)[self.lang[places]]
        for k in (0, 1):
            there = _set_bits(bitmap, shorter[places + k] ^ salt)
            places, salt = places[there], salt[there]
        return places

    def counted(self, places: np.ndarray, n: int) -> pa.RecordBatch:
        """(lang, phrase, n) of the n-grams that begin at places, each once."""
        coded = self.words.array().dictionary_encode()
        word, kinds = coded.indices.to_numpy().astype(np.int64), max(1, len(coded.dictionary))
        key, top = self.lang[places].astype(np.int64), max(1, len(self.langs))
        for k in range(n):
            if top > 2**62 // kinds:
                distinct, key = np.unique(key, return_inverse=True)
                top = len(distinct)
            key, top = key * kinds + word[places + k], top * kinds
        _, at, count = np.unique(key, return_index=True, return_counts=True)
        joined, begin = self.words.joined()
        start = begin[places[at]]
        text, cut = tokens.slices(joined, start, begin[places[at] + n] - 1 - start)
        phrases = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(cut), pa.py_buffer(text)])
        return pa.RecordBatch.from_arrays([self.langs.take(pa.array(self.lang[places[at]])), phrases.cast(pa.string()), pa.array(count, pa.int64())], names=["lang", "phrase", "n"])


def _set_bits(bitmap: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set."""
    bit = hashed & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


def _exploded(docs: DataFrame, n: int, bitmap: Broadcast | None) -> DataFrame:
    """(lang, phrase, n): rows of n-grams of (lang, text), summed within blocks; of words also their number, without a phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bitmap is None else np.frombuffer(bitmap.value, np.uint64)
        for batch in batches:
            for row, data, offsets in tokens.text_blocks(batch.column(1)):
                block = _Block(batch.column(0).slice(row, len(offsets) - 1), data, offsets)
                places = block.places(n, bits)
                if not len(places):
                    continue
                yield block.counted(places, n)
                if n == 1:
                    total = np.bincount(block.lang, minlength=len(block.langs))
                    yield pa.RecordBatch.from_arrays([block.langs, pa.nulls(len(total), pa.string()), pa.array(total, pa.int64())], names=["lang", "phrase", "n"])

    return docs.mapInArrow(run, "lang string, phrase string, n long")


def _bitmap(phrases: DataFrame) -> Broadcast:
    """The hashes of (lang, phrase) as a bitmap: of a size that their number gives and MOST_BITS bounds."""
    spark = phrases.sparkSession
    bits = 1 << max(12, min(MOST_BITS.bit_length() - 1, (phrases.count() * BITS_A_PHRASE).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            salt = _lang_hash(langs.dictionary)[langs.indices.to_numpy()]
            for row, data, offsets in tokens.text_blocks(batch.column(1)):
                words = tokens.Words(data, offsets, _SPACE)
                n = int(words.counts[0])  # all phrases have as many words
                hashed = tokens.ngrams(words.hashes(), n)[words.first[:-1]] ^ salt[row : row + len(offsets) - 1]
                bit = hashed & np.uint64(bits - 1)
                slot = (bit >> np.uint64(6)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array((np.uint64(1) << (bit & np.uint64(63))).view(np.int64))], names=["slot", "bits"])

    rows = phrases.select("lang", "phrase").mapInArrow(run, "slot int, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    found = np.zeros(bits // 64, np.int64)
    found[rows.column("slot").to_numpy()] = rows.column("bits").to_numpy()
    return spark.sparkContext.broadcast(found.tobytes())


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_n: int = 5, min_count: int = 100) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f): words and phrases of up to ``max_n`` words that occur ``min_count`` times; (lang, n): all words.

    Both are read back from the shared folder.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts, bitmap = [], None
    for n in range(1, max_n + 1):
        summed = _exploded(texts, n, bitmap).groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        level = storage.stored(summed.where(F.col("phrase").isNull() | (F.col("f") >= min_count)), f"phrases-{n}")
        if bitmap is not None:
            bitmap.destroy()
        if n == 1:
            totals = level.where("phrase IS NULL").select("lang", F.col("f").alias("n"))
            level = level.where("phrase IS NOT NULL")
        counts.append(level.select("lang", "phrase", F.lit(n).alias("size"), "f"))
        if n == max_n or level.isEmpty():
            break
        bitmap = _bitmap(level)
    found = counts[0]
    for level in counts[1:]:
        found = found.unionByName(level)
    return found, totals


def mine(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_n: int = 5, min_count: int = 100, first: int = 2000, factor: int = 1000, cover: int = 100) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``first`` phrases of each language by score, all numbers long.

    Texts, with A-Z in lower case, are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these into words
    ``[^\\x20\\x09]+``; n counts all words of a language. A candidate is a phrase of 2 to ``max_n`` words that occurs
    a >= ``min_count`` times within pieces, overlaps included. Cut after its first words it has parts with counts l and
    r and the score floor(factor * a * n / (l * r)); the cut with the lowest counts, of equal ones the first. A candidate
    is left out if a longer one that holds it has 100 * f >= cover * a. Ranks go by score and a, descending, then by the
    phrase's bytes. A null language is ``und``; null and empty texts have no words; repeated rows count as often as
    they occur. No rows, and no candidates, give no rows. Other columns are not read.
    """
    counts, totals = phrase_counts(docs, lang_col, text_col, max_n, min_count)
    spark, candidates = docs.sparkSession, counts.where("size > 1")
    words = F.split("phrase", " ")
    part = lambda begin, size: F.array_join(F.slice("words", begin, size), " ")
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), words.alias("words"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", F.col("k"), part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size("words")).alias("right"))
    of = lambda key, name: counts.select("lang", F.col("phrase").alias(key), F.col("f").alias(name))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"]).join(totals, "lang")
    # Counts have 19 digits at most, so that both products are exact in 38 up to some 10 to the 17 words.
    whole = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    score = F.expr(f"CAST({int(factor)} * CAST({whole('a')} * {whole('n')} AS DECIMAL(34, 0)) AS DECIMAL(38, 0)) div ({whole('l')} * {whole('r')})")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), lowest)
    longer = candidates.where("size > 2").select("lang", "f", words.alias("words"))
    inner = longer.select("lang", "f", F.explode(F.array(part(F.lit(1), F.size("words") - 1), part(F.lit(2), F.size("words") - 1))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    stands = (scored["lang"] == inner["lang"]) & (scored["phrase"] == inner["phrase"]) & (F.lit(100) * inner["f"] >= F.lit(cover) * scored["a"])
    left = scored.join(inner, stands, "left_anti")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    ranked = left.withColumn("rank", rank).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").cast("long").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the first 2000 phrases of each language of all documents."""
    return mine(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
s AS (SELECT lang, ws, unnest(range(1, 6)) AS size FROM w WHERE len(ws) > 0),
g AS (SELECT lang, size, ws, unnest(range(1, len(ws) - size + 2)) AS i FROM s WHERE len(ws) >= size),
f AS MATERIALIZED (SELECT lang, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
c AS MATERIALIZED (SELECT lang, size, phrase, string_split(phrase, ' ') AS ws, f AS a FROM f WHERE size > 1),
k AS (SELECT *, unnest(range(1, size)) AS k FROM c),
v AS (
  SELECT k.lang, k.phrase, k.a, k.k, l.f AS l, r.f AS r, t.n, ((1000::HUGEINT * k.a * t.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(k.ws[1:k.k], ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(k.ws[k.k + 1:], ' ') JOIN t ON t.lang = k.lang
), b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
x AS (
  SELECT lang, array_to_string(ws[1:size - 1], ' ') AS phrase, a AS f FROM c WHERE size > 2
  UNION ALL SELECT lang, array_to_string(ws[2:size], ' '), a FROM c WHERE size > 2
), y AS (SELECT lang, phrase, max(f) AS f FROM x GROUP BY lang, phrase)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, b.n, b.score
FROM b LEFT JOIN y ON y.lang = b.lang AND y.phrase = b.phrase AND 100 * y.f >= 100 * b.a WHERE y.f IS NULL
QUALIFY row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) <= 2000
"""
