"""Repair of conversations to turns of user and assistant, with the cheapest edits.

A row of a conversation is one character of its signature: what its role begins with and what is wrong with it. So a
conversation is as many bytes as it has rows, and its cheapest edits follow from the signature alone: each distinct
signature is solved once, by memoised recursion, and its audit (the edits' initials) is joined back to the
conversations that have it. Replaying an audit over the rows gives the repaired conversation.

Signatures and replays read a conversation's rows in order, as a stream: sorted by Spark, one row at a time in Python,
so that a conversation of any length takes bounded memory. Its texts are shuffled once, for the replay; for the
signature rows carry digests of their texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridweft import storage

#: Prices of edits; rows with these faults must go.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing said yet, after a system row, after a user row, after an assistant row.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: Inserts that can be worth it before the next row: (audit, state after them).
_INSERTS = {
    _START: (("", _START), ("I", _USER), ("II", _ASSISTANT)),
    _SYSTEM: (("", _SYSTEM), ("I", _USER), ("II", _ASSISTANT)),
    _USER: (("", _USER), ("I", _ASSISTANT)),
    _ASSISTANT: (("", _ASSISTANT), ("I", _USER)),
}
#: Places between which the recursion is begun anew, which bounds its depth.
_STRIDE = 100
#: Rows of a record batch.
_ROWS = 4096


def _kept(code: str, state: int) -> int | None:
    """The state after a kept row, if it may stand there."""
    if code == "s":
        return _SYSTEM if state == _START else None
    if code == "u":
        return _USER if state != _USER else None
    return _ASSISTANT if code == "a" and state == _USER else None


def _steps(code: str, state: int) -> Iterator[tuple[str, int, int]]:
    """(audit, price, next state) of all inserts before a row and the edit of the row."""
    for inserts, here in _INSERTS[state]:
        price = INSERT * len(inserts)
        yield inserts + "D", price + DELETE, here
        if code == "x":
            continue
        price += TRUNCATED * code.isupper()
        after = _kept(code.lower(), here)
        if after is not None:
            yield inserts + "K", price, after
        yield inserts + "R", price + REROLE, _ASSISTANT if here == _USER else _USER


def solve(signature: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits of a signature; of several the ASCII-least audit.

    A character is s, u, a or o (another role), in upper case if the row is truncated, or x if it must go.
    """
    n = len(signature)
    costs = np.full((n + 1, 4), -1, np.int64)
    costs[n] = [0, 2 * INSERT, INSERT, 0]

    def least(at: int, state: int) -> int:
        if costs[at, state] < 0:
            costs[at, state] = min(price + least(at + 1, after) for _, price, after in _steps(signature[at], state))
        return int(costs[at, state])

    for at in range(n - 1, -1, -_STRIDE):
        for state in range(4):
            least(at, state)
    audit, state = [], _START
    total = least(0, state)
    for at, code in enumerate(signature):
        # No step's letters begin another's, so that the least step begins the least audit.
        letters, _, state = min(step for step in _steps(code, state) if step[1] + least(at + 1, step[2]) == costs[at, state])
        audit.append(letters)
    audit.append("I" * (int(costs[n, state]) // INSERT))
    return total, "".join(audit)


def _rows(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(key, conv, turn, role, text): nulls of roles and texts as one space; a key that tells a null conversation apart."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit(""))
    return conversations.select(key.alias("key"), F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))


def _digest(role: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def _in_order() -> list[Column]:
    """The order of a conversation's rows: nulls first; rows of one turn by role, then by digest."""
    return [F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]


def faults(rows: DataFrame) -> DataFrame:
    """(key, turn, role, digest, fault): the first fault of each row (blank, duplicate, truncated) or null; no texts."""
    marked = rows.select(
        "key", "turn", "role", _digest(F.col("role"), F.col("text")).alias("digest"), F.col("text").rlike(r"[^\x20\x09-\x0D]").alias("said"), F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z").alias("ended")
    )
    seen = F.row_number().over(Window.partitionBy("key", "role", "digest").orderBy(F.asc_nulls_first("turn"))) > 1
    fault = F.when(~F.col("said"), "blank").when(seen, "duplicate").when(~F.col("ended"), "truncated")
    return marked.select("key", "turn", "role", "digest", fault.alias("fault"))


class _Count:
    """What is counted over a conversation's rows, in order."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = None
        self.last = None
        self.codes = bytearray()

    def add(self, turn: int | None, role: str, fault: str | None) -> None:
        initial = role[:1]
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if fault == "blank" or fault == "duplicate":
            self.codes += b"x"
            self.blank += fault == "blank"
            self.duplicate += fault == "duplicate"
        else:
            code = initial if initial in ("s", "u", "a") else "o"
            self.codes += (code.upper() if fault else code).encode()
            self.truncated += fault is not None

    def row(self, key: str) -> tuple:
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, 2**63 - 1)
        return key, self.codes.decode(), gaps, self.blank, self.duplicate, self.truncated, self.illegal


_SIGNED = pa.schema([("key", pa.string()), ("signature", pa.string()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal")]])


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = _ROWS, most_bytes: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Record batches of tuples, by rows and by the length of their texts."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= most or size >= most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation, from its rows in order."""

    def signed() -> Iterator[tuple]:
        now, count = None, _Count()
        for key, turn, role, fault in _streamed(batches):
            if key != now:
                if now is not None:
                    yield count.row(now)
                now, count = key, _Count()
            count.add(turn, role, fault)
        if now is not None:
            yield count.row(now)

    return _batches(signed(), _SIGNED)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("signature", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])
    return _batches(((s, *solve(s)) for (s,) in _streamed(batches)), schema)


def audits(rows: DataFrame) -> DataFrame:
    """(key, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation that has rows."""
    later = F.coalesce(F.col("fault") == "duplicate", F.lit(False))  # of equal rows of one turn
    ordered = faults(rows).repartition("key").sortWithinPartitions("key", *_in_order(), later).select("key", "turn", "role", "fault")
    signed = storage.stored(ordered.mapInArrow(_sign, "key string, signature string, gaps long, blank long, duplicate long, truncated long, illegal long"), "signatures")
    solved = signed.select("signature").distinct().mapInArrow(_solve, "signature string, cost long, audit string")
    return storage.stored(signed.join(solved, "signature").drop("signature"), "audits")


_REPAIRED = pa.schema([("key", pa.string()), ("seq", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired rows of conversations, each from its audit and its rows in order."""

    def repaired() -> Iterator[tuple]:
        key, audit, at, seq, state = None, "", 0, 0, _START

        def said(role: str, text: str) -> tuple:
            nonlocal seq, state
            seq += 1
            state = _SYSTEM if state == _START and role[:1] == "s" else _ASSISTANT if state == _USER else _USER
            return key, seq - 1, role, text

        demanded = lambda: "assistant" if state == _USER else "user"

        def inserted() -> Iterator[tuple]:
            nonlocal at
            while audit[at : at + 1] == "I":
                at += 1
                yield said(demanded(), "")

        for found, edits, role, text in _streamed(batches):
            if edits is not None:
                yield from inserted()
                key, audit, at, seq, state = found, edits, 0, 0, _START
                continue
            yield from inserted()
            edit, at = audit[at], at + 1
            if edit == "K":
                yield said(role, text)
            elif edit == "R":
                yield said(demanded(), text)
        yield from inserted()

    return _batches(repaired(), _REPAIRED)


def replayed(rows: DataFrame, audit_rows: DataFrame) -> DataFrame:
    """(key, seq, role, text): repaired conversations, each in one partition and in order."""
    nothing = {"turn": F.lit(None).cast("long"), "role": F.lit(""), "text": F.lit(""), "digest": F.lit(b"")}
    own = rows.select("key", "turn", "role", "text", _digest(F.col("role"), F.col("text")).alias("digest"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("audit"))
    both = own.unionByName(audit_rows.select("key", "audit", F.lit(0).alias("kind")).withColumns(nothing))
    ordered = both.repartition("key").sortWithinPartitions("key", "kind", *_in_order()).select("key", "audit", "role", "text")
    return ordered.mapInArrow(_replay, "key string, seq long, role string, text string")


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """What is wrong with conversations, and the repaired rows.

    The first table, (conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit), has a row for each
    conversation; the second is (conv_col, seq, role, text), seq from 0. Rows go by turn, nulls first; rows of one turn
    by role and then by the SHA-256 of role and text, so that repeated rows are side by side. A null role or text
    counts as one space; rows without a conversation are one. A row's first fault counts: blank (nothing but
    ``[\\x20\\x09-\\x0D]``), duplicate (role and text seen earlier), truncated (the last other character is not
    ``[.!?]``). Initials are case-sensitive; a role that is empty or begins otherwise fits nowhere until it is changed.
    ``gaps`` is the largest less the smallest turn plus 1 less the different turns. An empty table gives no rows; other
    columns are not read.
    """
    rows = _rows(conversations, conv_col, turn_col, role_col, text_col)
    found = audits(rows)
    kind = conversations.schema[conv_col].dataType.simpleString()
    back = F.when(F.col("key") != "", F.substr("key", F.lit(2))).cast(kind).alias(conv_col)
    return found.select(back, *found.columns[1:]), replayed(rows, found).select(back, "seq", "role", "text")


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults by the checksum of ``conv_id:turn``, nulls as one space; the columns of _rows()."""
    rows = _rows(conversations, "conv_id", "turn", "role", "text")
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    times = F.when(kind == 0, F.expr("array()").cast("array<int>")).when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("key", "conv", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("nth")).drop("nth")


def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each conversation's ``role:text`` lines, from its rows in order."""

    def hashed() -> Iterator[tuple]:
        now, digest = None, hashlib.sha256()
        for key, role, text in _streamed(batches):
            if key != now:
                if now is not None:
                    yield now, digest.hexdigest()
                now, digest = key, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        if now is not None:
            yield now, digest.hexdigest()

    return _batches(hashed(), pa.schema([("key", pa.string()), ("repaired_sha256", pa.string())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: all conversations, damaged and repaired."""
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = damaged(given)
    found = audits(rows)
    hashes = replayed(rows, found).select("key", "role", "text").mapInArrow(_hash_lines, "key string, repaired_sha256 string")
    all_convs = _rows(given, "conv_id", "turn", "role", "text").select("key", "conv").distinct()
    out = all_convs.join(found, "key", "left").join(hashes, "key", "left")
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("conv").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def _oracle() -> str:
    """DuckDB SQL: a table-driven checksum, and costs and audits backwards over each conversation's rows."""
    steps: dict[int, list[str]] = {s: [] for s in range(4)}
    for state, options in steps.items():
        for letters, after in _INSERTS[state]:
            price = INSERT * len(letters)
            cell = lambda extra, letter, to, when: f"CASE WHEN {when} THEN lpad((c{to} + {extra})::VARCHAR, 9, '0') || '{letter}' || a{to} END"
            options.append(cell(price + DELETE, letters + "D", after, "true"))
            late = "(CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END)"
            alive = "coalesce(fault, '') NOT IN ('blank', 'duplicate')"
            for code in "sua":
                to = _kept(code, after)
                if to is not None:
                    options.append(cell(f"{price} + {late}", letters + "K", to, f"{alive} AND role[1] = '{code}'"))
            options.append(cell(f"{price + REROLE} + {late}", letters + "R", _ASSISTANT if after == _USER else _USER, alive))
    best = ", ".join(f"least({', '.join(options)}) AS b{s}" for s, options in steps.items())
    unpacked = ", ".join(f"substr(b{s}, 1, 9)::BIGINT AS c{s}, substr(b{s}, 10) AS a{s}" for s in range(4))
    return rf"""
WITH RECURSIVE bits AS (
  SELECT b, b::UBIGINT AS v, 0 AS k FROM range(256) t(b)
  UNION ALL SELECT b, CASE WHEN v % 2 = 1 THEN xor(3988292384::UBIGINT, v >> 1) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8),
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS said FROM conversations),
kinds AS (
  SELECT given.*, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(said) + 1), lambda i: ascii(said[i])::UBIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255)::INT + 1])), 4294967295::UBIGINT) % 20 AS kind FROM given, crc
), rows_ AS (
  SELECT coalesce('=' || conv_id::VARCHAR, '') AS key, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS nth FROM kinds
), digested AS (SELECT *, sha256(strlen(role)::VARCHAR || ':' || role || text) AS digest FROM rows_),
marked AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY key, role, text ORDER BY turn NULLS FIRST, nth) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault FROM digested
), numbered AS MATERIALIZED (
  SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY key) AS n, lag(role[1]) OVER w || role[1] AS pair FROM marked WINDOW w AS (PARTITION BY key ORDER BY turn NULLS FIRST, role, digest, (fault IS NOT NULL AND fault = 'duplicate'))
), counted AS (
  SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM numbered GROUP BY key
), costs AS (
  SELECT key, n AS place, 0::BIGINT AS c0, '' AS a0, 6::BIGINT AS c1, 'II' AS a1, 3::BIGINT AS c2, 'I' AS a2, 0::BIGINT AS c3, '' AS a3 FROM numbered WHERE rn = 1
  UNION ALL SELECT key, place, {unpacked} FROM (SELECT c.key, c.place - 1 AS place, {best} FROM costs c JOIN numbered r ON r.key = c.key AND r.rn = c.place)
), solved AS MATERIALIZED (SELECT key, c0 AS cost, a0 AS audit FROM costs WHERE place = 0),
edits AS (
  SELECT key, i, audit[i] AS edit, count(*) FILTER (WHERE audit[i] <> 'I') OVER (PARTITION BY key ORDER BY i) AS rn FROM (SELECT key, audit, unnest(range(1, length(audit) + 1)) AS i FROM solved)
), outs AS (
  SELECT e.key, e.i, e.edit, r.role, CASE WHEN e.edit = 'I' THEN '' ELSE r.text END AS text, e.edit = 'K' AND r.role[1] = 's' AS is_system FROM edits e LEFT JOIN numbered r ON r.key = e.key AND r.rn = e.rn WHERE e.edit <> 'D'
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY i) - max(is_system::INT) OVER (PARTITION BY key) AS k FROM outs
), lines AS (
  SELECT key, string_agg(CASE WHEN edit = 'K' THEN role WHEN k % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i) AS whole FROM placed GROUP BY key
), convs AS (SELECT DISTINCT conv_id, coalesce('=' || conv_id::VARCHAR, '') AS key FROM conversations)
SELECT v.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM convs v LEFT JOIN counted USING (key) LEFT JOIN solved USING (key) LEFT JOIN lines USING (key)
"""


ORACLE_SQL = _oracle()
