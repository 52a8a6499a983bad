"""Piece coding, phrases and conversation repair against the library and brute force."""

import hashlib
import itertools
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece

from gridweft.llm import collocations, conversations, piece_coding, tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return piece_coding.PieceModel(PATH)


def _texts(library, seed: int) -> list[str]:
    r = random.Random(seed)
    pieces = [library.id_to_piece(i) for i in range(259, library.get_piece_size())]
    alphabet = "abcdehinorstw  ▁\t\n日é́😀<s></s>0x0A.'\"Ω"
    made = ["".join(r.choices(alphabet, k=r.randrange(80))) for _ in range(400)]
    made += ["".join(r.choices(" ▁a", k=r.randrange(80))) for _ in range(200)]
    made += ["".join(r.choices(pieces, k=r.randrange(40))) for _ in range(300)]
    return made + ["".join(r.choices(pieces, k=r.randrange(40))).replace("▁", "") for _ in range(300)]


def test_ids_as_the_library(library, model):
    long = [" " * 3000, "a" * 20000, "ab" * 9000, "=-" * 2000, "the" * 9000, "", " "]
    texts = _texts(library, 5) + long
    got = []
    for _, data, offsets in tokens.text_blocks(pa.array(texts), 1 << 14):
        ids, first = piece_coding.encode_block(model, data, offsets)
        got += [ids[a:b].tolist() for a, b in itertools.pairwise(first)]
    assert got == library.encode(texts, num_threads=1)


def test_texts_as_the_library(library, model):
    r = random.Random(3)
    ids = [[r.choice((0, 1, 2, 29871, 259, r.randrange(3, 259), r.randrange(32000))) for _ in range(r.randrange(12))] for _ in range(3000)]
    first = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    assert piece_coding.decode_block(model, np.array(sum(ids, [])), first) == library.decode(ids)
    with pytest.raises(ValueError):
        piece_coding.decode_block(model, np.array([32000]), np.array([0, 1]))


def test_pair_by_pair_is_as_in_rounds(library, model):
    for text in _texts(library, 9)[:300]:
        symbols = model.symbol[[ord(c) for c in text.replace(" ", "▁")]].tolist()
        if symbols:
            rounds, _ = piece_coding.merged(model, np.array(symbols, np.int32), np.array([0, len(symbols)]))
            assert piece_coding._one_by_one(model, symbols) == rounds.tolist()


def test_coding_of_edge_rows(edge, empty, library):
    rows = piece_coding.decode(piece_coding.encode(edge, PATH), PATH).collect()
    want = [(r["doc_id"], library.encode(r["text"] or "", add_eos=True), r["text"] or "") for r in edge.collect()]
    assert sorted(map(repr, rows)) == sorted(repr(type(rows[0])(doc_id=i, ids=ids, decoded=t)) for i, ids, t in want)
    at_once = piece_coding.encode(edge, PATH, decoded="decoded").collect()
    assert sorted(map(repr, at_once)) == sorted(map(repr, rows))
    assert piece_coding.encode(empty, PATH).collect() == []
    assert piece_coding.encode(edge.where("doc_id = 3"), PATH, bos=True).first()["ids"] == [1, 2]
    bare = edge.sparkSession.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r["decoded"] for r in piece_coding.decode(bare, PATH).collect()] == ["", ""]


def _mined(rows, max_n, least, first, cover):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            low = low.replace(c, "\n")
        for piece in low.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            totals[lang] += len(words)
            for n in range(1, max_n + 1):
                counts.update((lang, tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    found = {k: v for k, v in counts.items() if v >= least and len(k[1]) > 1}
    out = []
    for (lang, p), a in found.items():
        longer = [v for (g, q), v in found.items() if g == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * v >= cover * a for v in longer):
            continue
        cuts = [(1000 * a * totals[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, " ".join(p), a, counts[lang, p[:k]], counts[lang, p[k:]], totals[lang], score))
    ranked = []
    for lang in {o[0] for o in out}:
        own = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))
        ranked += [(o[0], i + 1, *o[1:]) for i, o in enumerate(own[:first])]
    return sorted(ranked)


@pytest.mark.parametrize(("cover", "most_bits"), [(100, 1 << 26), (60, 1 << 12)])
def test_phrases_against_brute_force(spark, monkeypatch, cover, most_bits):
    monkeypatch.setattr(collocations, "MOST_BITS", most_bits)
    r = random.Random(cover)
    words = ["a", "b", "É", "the", "of", "x-y", "ﬁ", "q"]
    texts = ["".join(r.choice(words) + r.choice(["  ", " ", "\t", " ", " ", ". ", "\n", "?"]) for _ in range(r.randrange(60))) for _ in range(150)]
    rows = [(r.choice(["en", "de", None, "und", ""]), t) for t in texts] + [("en", None), ("en", ""), ("en", " . \n"), ("de", "A B " * 3000)] + [("en", texts[0])] * 5
    docs = spark.createDataFrame([(None, lang, t, 1, "s") for lang, t in rows], "doc_id long, lang string, text string, n long, phrase string")
    got = sorted(tuple(x) for x in collocations.mine(docs, min_count=12, first=25, cover=cover).collect())
    assert got == _mined(rows, 5, 12, 25, cover)
    assert got
    assert collocations.mine(docs.where("false")).collect() == []
    assert collocations.mine(docs, min_count=10**6).collect() == []


def test_scores_are_exact(spark):
    """Counts beyond 64-bit products: the score's expression in decimals against fractions."""
    a, n, left, right = 123_456_789_012, 9_876_543_210_987, 123_456_789_013, 555_555_555_555
    want = Fraction(1000 * a * n, left * right)
    text = f"CAST(1000 * CAST(CAST({a} AS DECIMAL(19, 0)) * CAST({n} AS DECIMAL(19, 0)) AS DECIMAL(34, 0)) AS DECIMAL(38, 0)) div (CAST({left} AS DECIMAL(19, 0)) * CAST({right} AS DECIMAL(19, 0)))"
    assert spark.sql(f"SELECT {text} AS x").first()["x"] == want.numerator // want.denominator


def _cheapest(signature: str) -> tuple[int, str]:
    """All edit sequences by increasing cost, from a search over (place, roles so far)."""
    import heapq

    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, said = heapq.heappop(heap)
        if at == len(signature) and (not said or said in ("sua", "ua")):
            return cost, audit
        if (at, said) in seen:
            continue
        seen.add((at, said))

        def on(price, letter, to, role):
            grown = said + role
            short = {"": "", "s": "s", "u": "u", "su": "su", "ua": "ua", "sua": "sua", "uau": "u", "suau": "su"}.get(grown)
            if short is not None:
                heapq.heappush(heap, (cost + price, audit + letter, to, short))

        for role in "ua":
            on(3, "I", at, role)
        if at < len(signature):
            code = signature[at]
            on(4, "D", at + 1, "")
            if code != "x":
                late = 3 * code.isupper()
                if code.lower() != "o":
                    on(late, "K", at + 1, code.lower())
                for role in "ua":
                    on(3 + late, "R", at + 1, role)
    raise AssertionError


def test_every_short_signature():
    for n in range(5):
        for letters in itertools.product("suaoSUAOx", repeat=n):
            signature = "".join(letters)
            assert conversations.solve(signature) == _cheapest(signature), signature
    long = "".join(random.Random(1).choices("suaoSUAOx", k=3000))
    cost, audit = conversations.solve(long)
    assert cost > 0 and len(audit.replace("I", "")) == 3000


def _by_hand(rows):
    """The query of op13 in plain Python over (conv, turn, role, text)."""
    convs, blank_set = {}, " \t\n\x0b\x0c\r"
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, own in convs.items():
        digest = lambda r: hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).hexdigest()
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), digest(r)))
        seen, codes, found = set(), [], Counter()
        for turn, role, text in own:
            bare = text.strip(blank_set)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            found[fault] += 1
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            codes.append("x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial)
        turns = {r[0] for r in own if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit = _cheapest("".join(codes))
        lines, at, expected = [], 0, "user"
        for letter in audit:
            row = own[at] if letter != "I" else None
            at += letter != "I"
            if letter == "D":
                continue
            if letter == "K" and row[1][0] == "s":
                lines.append(f"{row[1]}:{row[2]}")
                continue
            lines.append(f"{row[1] if letter == 'K' else expected}:{row[2] if row else ''}")
            expected = "assistant" if expected == "user" else "user"
        out.append((conv, gaps, found["blank"], found["duplicate"], found["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_repair_against_brute_force(spark, tmp_path):
    r = random.Random(8)
    said = ["Yes.", "No", "Why? ", "", " \n", "A b.", None, "Well!\t", "é…"]
    roles = ["user", "assistant", "system", "tool", "", None, "User"]
    rows = [(c, t, r.choice(roles[: r.choice((2, 3, 7))]), r.choice(said)) for c in range(150) for t in range(r.randrange(7))]
    rows += [(200, None, "user", "Yes."), (200, None, "user", "Yes."), (200, 3, "assistant", "No."), (None, 0, "user", "Hi."), (None, 5, "assistant", "Yes."), (201, 0, "user", "word " * 50000 + ".")]
    rows += rows[:40]
    table = spark.createDataFrame([(*x, 1, "k") for x in rows], "conv_id long, turn long, role string, text string, seq int, key string")
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    got = conversations.query(spark, str(tmp_path)).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()
    assert sorted((tuple(x) for x in got), key=repr) == _by_hand(rows)


def test_repaired_rows(spark):
    table = spark.createDataFrame([("c", 1, "assistant", "Hello."), ("c", 2, "assistant", "So."), (None, 1, None, "Hm."), ("d", 1, "user", "cut")], "conv_id string, turn long, role string, text string")
    found, repaired = conversations.repair(table)
    assert {(r["conv_id"], r["audit"], r["cost"]) for r in found.collect()} == {("c", "RK", 3), (None, "D", 4), ("d", "D", 4)}
    assert [tuple(r) for r in repaired.orderBy("seq").collect()] == [("c", 0, "user", "Hello."), ("c", 1, "assistant", "So.")]
    nothing, no_rows = conversations.repair(table.where("false"))
    assert nothing.collect() == no_rows.collect() == []
