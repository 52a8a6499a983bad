"""SentencePiece encoding and decoding (BPE with byte fallback) by vectorised merge rounds.

A block of texts becomes one array of characters, cut into words where no piece of the vocabulary holds the two
characters at the cut, so that no merge crosses it. Distinct words are encoded once a block: a flat array of symbols in
which every round finds the least pair rank of each word (a segmented minimum), merges its occurrences from the left
at once and compacts the array, until no pair is left. The library takes one pair at a time, the best rank first and
the leftmost of equal ones; merging all occurrences at once gives the same, unless a merge makes a pair with a
neighbour that is no worse. Such a merge is the last one of its word's round.

The vocabulary is read from the given model file; nothing is trained.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweft.llm import tokens

#: Text that is encoded at once; more text has fewer words that differ.
BLOCK_BYTES = 1 << 20
#: Rounds after which what is left of very long words is merged pair by pair.
ROUNDS = 64

_BLANK = 0x2581
_NONE = np.iinfo(np.int32).max


class PieceModel:
    """A model file's vocabulary as arrays.

    Symbols are piece ids, and the number of pieces plus the code point for characters that are no piece. Models of
    another kind (no byte fallback, a normaliser that changes texts, user-defined pieces) are errors.
    """

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n = n = library.get_piece_size()
        self.eos, self.bos = library.eos_id(), library.bos_id()
        pieces = [library.id_to_piece(i) for i in range(n)]
        special = np.array([library.is_control(i) or library.is_unknown(i) for i in range(n)])
        is_byte = np.array([library.is_byte(i) for i in range(n)])
        probe = " Åﬁ \t a\n "
        if is_byte.sum() != 256 or library.normalize(probe) != "▁" + probe.replace(" ", "▁") or library.encode(pieces[-1] + "<s>") == [n - 1, self.bos]:
            raise ValueError(f"{path} is no model with byte fallback, a blank in front and texts that are otherwise unchanged")
        self.control, self.unknown = np.array([library.is_control(i) for i in range(n)]), library.unk_id()
        self.is_byte, self.is_special = is_byte, special
        self.byte_ids = np.zeros(256, np.int32)
        for i in np.flatnonzero(is_byte).tolist():
            self.byte_ids[int(pieces[i][3:5], 16)] = i
        self._pairs(library, pieces, ~(special | is_byte))
        self._surfaces(library, pieces)

    def _pairs(self, library, pieces: list[str], plain: np.ndarray) -> None:
        """Ranks and results of pairs of symbols, symbols of characters, and which neighbours a piece holds."""
        ids = {pieces[i]: i for i in np.flatnonzero(plain).tolist()}
        scores = np.array([library.get_score(i) for i in range(self.n)], np.float32)
        _, rank = np.unique(-scores, return_inverse=True)
        self.piece_rank = rank.astype(np.int32)
        self.symbol = np.arange(0x110000, dtype=np.int32) + self.n
        for piece, i in ids.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        symbol_of = lambda s: ids.get(s, self.n + ord(s) if len(s) == 1 else None)
        key, made = [], []
        self.letter = np.zeros(0x110000, np.int32)
        letters = sorted({c for p in ids if len(p) > 1 for c in p})
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.beside = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for piece, i in ids.items():
            codes = self.letter[[ord(c) for c in piece]]
            self.beside[codes[:-1], codes[1:]] = True
            for k in range(1, len(piece)):
                left, right = symbol_of(piece[:k]), symbol_of(piece[k:])
                if left is not None and right is not None:
                    key.append(left << 32 | right)
                    made.append(i)
        order = np.argsort(np.array(key, np.int64))
        self.pair_key, self.pair_made = np.array(key, np.int64)[order], np.array(made, np.int32)[order]
        # Pieces from which a pair comes that ranks no worse than the piece itself.
        early = np.zeros(self.n + 0x110000, bool)
        rank_made = self.piece_rank[self.pair_made]
        for part in (self.pair_key >> 32, self.pair_key & 0xFFFFFFFF):
            known = part < self.n
            early[part[known]] |= rank_made[known] <= self.piece_rank[part[known]]
        self.early = early

    def _surfaces(self, library, pieces: list[str]) -> None:
        """The bytes that each id stands for."""
        said = [b"" if self.control[i] else library.decode([i]).encode() if i == self.unknown else bytes([int(pieces[i][3:5], 16)]) if self.is_byte[i] else pieces[i].replace("▁", " ").encode() for i in range(self.n)]
        self.surface = np.frombuffer(b"".join(said), np.uint8)
        self.surface_at = np.concatenate([[0], np.cumsum([len(s) for s in said])])
        self.opens_blank = np.array([p.startswith("▁") for p in pieces]) & ~self.is_special & ~self.is_byte

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) of pairs of symbols; the rank of a pair that is no piece is _NONE."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        made = self.pair_made[at]
        return np.where(self.pair_key[at] == key, self.piece_rank[made], _NONE), made


@lru_cache(maxsize=2)
def _model(path: str) -> PieceModel:
    return PieceModel(path)


def _one_by_one(model: PieceModel, symbols: list[int]) -> list[int]:
    """The merges of one long word pair by pair, best first, from a heap."""
    after, before, alive = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1)), [True] * len(symbols)
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(lefts: list[int]) -> None:
        lefts = [i for i in lefts if 0 <= i and after[i] < len(symbols)]
        if lefts:
            rights = [after[i] for i in lefts]
            rank, made = model.pair(np.array([symbols[i] for i in lefts]), np.array([symbols[i] for i in rights]))
            for i, j, r, m in zip(lefts, rights, rank.tolist(), made.tolist(), strict=True):
                if r != _NONE:
                    heapq.heappush(heap, (r, i, symbols[i], symbols[j], m))

    offer(list(range(len(symbols) - 1)))
    while heap:
        _, i, left, right, made = heapq.heappop(heap)
        j = after[i] if alive[i] else len(symbols)
        if j >= len(symbols) or symbols[i] != left or symbols[j] != right:
            continue
        symbols[i], alive[j] = made, False
        after[i] = after[j]
        if after[i] < len(symbols):
            before[after[i]] = i
        offer([before[i], i])
    return [s for s, there in zip(symbols, alive, strict=True) if there]


def merged(model: PieceModel, sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of words after all merges and where each word begins, from the symbols and beginnings before."""
    count = len(first) - 1
    own = np.repeat(np.arange(count), np.diff(first))
    lead = np.zeros(len(sym), bool)
    lead[first[:-1]] = True
    rank, made = np.full(len(sym), _NONE, np.int32), np.zeros(len(sym), np.int32)
    if len(sym) > 1:
        rank[:-1], made[:-1] = model.pair(sym[:-1], sym[1:])
        rank[:-1][lead[1:]] = _NONE
    ended: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(ROUNDS):
        if not len(sym):
            break
        starts = np.flatnonzero(lead)
        target = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(sym))))
        over = target == _NONE
        if over.any():
            ended.append((own[over], sym[over]))
            left = ~over
            sym, own, lead, rank, made, target = sym[left], own[left], lead[left], rank[left], made[left], target[left]
            if not len(sym):
                break
        hit = np.flatnonzero(rank == target)
        # Of pairs that overlap in a row every other one is merged, beginning with the leftmost.
        run = np.append(True, hit[1:] != hit[:-1] + 1)
        nth = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
        hit = hit[nth % 2 == 0]
        hit = hit[_in_turn(model, sym, own, rank, made, hit)]
        sym[hit] = made[hit]
        keep = np.ones(len(sym), bool)
        keep[hit + 1] = False
        sym, own, lead, rank, made = sym[keep], own[keep], lead[keep], rank[keep], made[keep]
        at = hit - np.arange(len(hit))
        changed = np.unique(np.append(at, (at - 1)[~lead[at]]))
        inner = changed[changed + 1 < len(sym)]
        inner = inner[~lead[inner + 1]]
        rank[changed] = _NONE
        rank[inner], made[inner] = model.pair(sym[inner], sym[inner + 1])
    if len(sym):
        starts = np.flatnonzero(lead)
        for word in np.split(np.arange(len(sym)), starts[1:]):
            done = np.array(_one_by_one(model, sym[word].tolist()), sym.dtype)
            ended.append((np.full(len(done), own[word[0]]), done))
    own = np.concatenate([o for o, _ in ended]) if ended else own
    sym = np.concatenate([s for _, s in ended]) if ended else sym
    order = np.argsort(own, kind="stable")
    return sym[order], np.searchsorted(own[order], np.arange(count + 1))


def _in_turn(model: PieceModel, sym: np.ndarray, own: np.ndarray, rank: np.ndarray, made: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """Which of a round's merges come before any pair that one of them makes: all up to the first that makes one."""
    new = made[hit]
    risky = np.flatnonzero(model.early[new])
    if not len(risky):
        return np.ones(len(hit), bool)
    place, piece = hit[risky], new[risky]
    merged_before = (risky > 0) & (hit[risky - 1] == place - 2)
    before = np.where(merged_before, new[risky - 1], sym[np.maximum(place - 1, 0)])
    after = np.minimum(place + 2, len(sym) - 1)
    left = np.where((place > 0) & (own[np.maximum(place - 1, 0)] == own[place]), model.pair(before, piece)[0], _NONE)
    right = np.where((place + 2 < len(sym)) & (own[after] == own[place]), model.pair(piece, sym[after])[0], _NONE)
    breaks = np.zeros(len(hit), bool)
    breaks[risky] = np.minimum(left, right) <= rank[place]
    seen = np.cumsum(breaks) - breaks
    begin = np.searchsorted(own[hit], own[hit], "left")
    return seen == seen[begin]


def encode_block(model: PieceModel, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts of a block, without end ids, and where each text's ids begin."""
    size = np.diff(offsets)
    code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int32)
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    code[code == 32] = _BLANK
    filled = np.flatnonzero(size > 0)
    code = np.insert(code, begins[filled], _BLANK)
    begins = begins + np.concatenate([[0], np.cumsum(size > 0)])
    if not len(code):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    letter = model.letter[code]
    cut = np.ones(len(code), bool)
    cut[1:] = ~model.beside[letter[:-1], letter[1:]]
    cut[begins[filled]] = True
    at = np.append(np.flatnonzero(cut), len(code))
    words = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at * 4), pa.py_buffer(code)]).dictionary_encode()
    which, distinct = words.indices.to_numpy(), words.dictionary
    first = np.frombuffer(distinct.buffers()[1], np.int64)[: len(distinct) + 1] // 4
    letters = np.frombuffer(distinct.buffers()[2], np.int32)[: first[-1]]
    sym, first = merged(model, model.symbol[letters], first)
    ids, first = _with_bytes(model, sym, first)
    ids, at_word = tokens.slices(ids, first[which], np.diff(first)[which])
    return ids, at_word[np.searchsorted(at[:-1], begins)]


def _with_bytes(model: PieceModel, sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of symbols: a character that is no piece becomes the ids of its bytes."""
    other = np.flatnonzero(sym >= model.n)
    if not len(other):
        return sym, first
    code = sym[other] - model.n
    raw = np.frombuffer(code.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
    size = np.ones(len(sym), np.int64)
    size[other] += (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
    end = np.cumsum(size)
    ids = np.repeat(sym, size)
    ids[np.repeat(sym >= model.n, size)] = model.byte_ids[raw]
    return ids, np.concatenate([[0], end])[first]


def decode_block(model: PieceModel, ids: np.ndarray, first: np.ndarray) -> list[str]:
    """Texts of lists of ids, from all ids and where each list begins."""
    if len(ids) and (ids.min() < 0 or ids.max() >= model.n):
        raise ValueError("an id is not in the vocabulary")
    raw, begin = tokens.slices(model.surface, model.surface_at[ids], np.diff(model.surface_at)[ids])
    begin, end = begin[first[:-1]].copy(), begin[first[1:]]
    # A blank that opens the first visible piece is the one that encoding puts in front.
    seen = np.flatnonzero(~model.control[ids])
    lead = np.searchsorted(seen, first[:-1])
    has = lead < np.searchsorted(seen, first[1:])
    begin[has] += model.opens_blank[ids[seen[lead[has]]]]
    whole = raw.tobytes()
    # Silent ids part runs of byte pieces, whose bytes are then no characters together.
    parted = np.flatnonzero(model.control[ids[:-1]] & model.is_byte[ids[1:]])
    odd = set((np.searchsorted(first, parted, "right") - 1).tolist())
    out = []
    for i, (b, e) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
        try:
            out.append(_with_replacements(model, ids[first[i] : first[i + 1]]) if i in odd else whole[b:e].decode())
        except UnicodeDecodeError:
            out.append(_with_replacements(model, ids[first[i] : first[i + 1]]))
    return out


def _with_replacements(model: PieceModel, ids: np.ndarray) -> str:
    """The text of ids whose byte pieces are no valid UTF-8: in every run of them each invalid byte is replaced."""
    out, run = [], b""
    for i in [*ids.tolist(), model.eos]:
        said = model.surface[model.surface_at[i] : model.surface_at[i + 1]].tobytes()
        if model.is_byte[i]:
            run += said
            continue
        while run:
            step = next((k for k in (1, 2, 3, 4) if _is_char(run[:k])), 0)
            out.append(run[:step].decode() if step else "�")
            run = run[step or 1 :]
        out.append(said.decode())
    whole = "".join(out)
    seen = [i for i in ids.tolist() if not model.control[i]]
    return whole[1:] if seen and model.opens_blank[seen[0]] else whole


def _is_char(data: bytes) -> bool:
    try:
        return len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", bos: bool = False, eos: bool = True, decoded: str | None = None) -> DataFrame:
    """(id_col, ids): the ids of every row's whole text, as the library gives them without sampling, one row a row.

    With ``decoded`` a third column of this name has what decode() gives for the ids, made in the same task. Null and
    empty texts have no ids but the begin and end id, where these are asked for. Rows that share an id, and rows
    without one, are encoded each by itself; other columns are not read. An empty table gives no rows. ``path`` is a
    model file that every executor can read, as an installed package's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        ends = [*([model.bos] if bos else []), *([model.eos] if eos else [])]
        for batch in batches:
            for row, data, offsets in tokens.text_blocks(batch.column(1), BLOCK_BYTES):
                ids, first = encode_block(model, data, offsets)
                n = len(offsets) - 1
                ids = np.insert(ids, np.concatenate([np.repeat(first[:-1], bos), np.repeat(first[1:], eos)]), np.repeat(ends, n))
                first = first + (bos + eos) * np.arange(n + 1)
                columns = [batch.column(0).slice(row, n), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))]
                if decoded:
                    columns.append(pa.array(decode_block(model, ids, first), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "ids", "decoded"][: len(columns)])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    names = [id_col, "ids", *([decoded] if decoded else [])]
    return rows.mapInArrow(run, f"id {kind}, ids array<int>" + ", decoded string" * bool(decoded)).toDF(*names)


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """(id_col, ids, text_col): rows with the text that the library's decode() gives for their ids.

    A null list counts as an empty one and gives the empty text; a null or unknown id within a list is an error. Begin
    and end ids are silent. Byte pieces that are no UTF-8 become U+FFFD, one a byte. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in batches:
            lists = batch.column(1)
            ids = lists.flatten()
            if ids.null_count:
                raise ValueError("an id is null")
            size = lists.value_lengths().fill_null(0).to_numpy()
            texts = decode_block(model, ids.to_numpy(), np.concatenate([[0], np.cumsum(size)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(texts, pa.string())], names=["id", "ids", "text"])

    chosen = rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = chosen.schema["id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"id {kind}, ids array<int>, text string").toDF(id_col, "ids", text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: all documents encoded with an end id, and decoded again."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, decoded="decoded")
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(ids).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))
