"""Resampling, packing by slack and filling in the middle against brute force, the libraries and round trips."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from usage_ts.llm import byte_tokens, fill_middle, importance, queries, slack_packing

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, row string, score string, rank string, piece string, form string"
LONG = " ".join(f"w{i * 7919 % 5003}" for i in range(20_000))
ODD_TEXTS = [None, "", " \t\n", "a", "A b", "été ça!", LONG, LONG, "x" * 5000, "\n" * 70_000 + "end", "a<M>b\nc", "日本語 <|endoftext|> ok"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, null ids and columns with clashing names."""
    rows = [(i, t, None, "r", "s", "k", "p", "f") for i, t in enumerate(ODD_TEXTS)]
    return spark.createDataFrame(rows + [rows[6], rows[3], (None, LONG, *"abcdef"), (None, None, *[None] * 6)], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def texts_of(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


# 11: resampling


def plain_features(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", low)
    return len(words), [zlib.crc32(f.encode()) % 10_000 for f in [*words, *map(" ".join, zip(words, words[1:]))]]


def plain_draw(docs, target):
    """Rows (doc_id, n_features, weight, score, rank), sorted."""
    own = [(i, *plain_features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in plain_features(x)[1])
    total, wanted = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total + 10_000) / ((s[b] + 1) * (wanted + 10_000)))) for b in s}
    rows = []
    for i, n, f in own:
        weight = sum(map(gain.__getitem__, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= 20))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    ranked = [(*r[:4], k if k <= len(able) * 25 // 100 else None) for k, r in enumerate(able, start=1)]
    return sorted(ranked + [(*r[:4], None) for r in rows if not r[4]], key=str)


def drawn(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect()), key=str)


def test_draw_equals_brute_force(spark):
    got = drawn(queries.op11_importance_resampling(spark, SF))
    assert got == plain_draw([(r["doc_id"], r["text"]) for r in texts_of("documents")], [r["text"] for r in texts_of("benchmark")])


def test_draw_defined_cases(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = drawn(importance.resample(odd, odd.limit(7)))
    assert got == plain_draw(rows, [t for _, t in rows[:7]])
    assert importance.resample(empty, odd).count() == 0
    assert drawn(importance.resample(odd, empty)) == plain_draw(rows, [])
    assert dict(importance.resample(odd, odd).dtypes) == dict.fromkeys(("doc_id", "n_features", "weight", "score", "rank"), "bigint")


def test_crcs_of_spans_of_any_length():
    rng = random.Random(3)
    sizes = [1, 2, 30, 31, 32, 33, 62, 63, 64, 65, 127, 128, 129, 192, 193, 1000, 4097, 100_001]
    texts = []
    for _ in range(40):
        words = ["".join(rng.choice("abz09éß漢") for _ in range(rng.choice(sizes) if rng.random() < 0.3 else rng.randint(1, 9))) for _ in range(rng.randint(0, 30))]
        texts.append("".join(w + rng.choice([" ", ", ", "\n\n", "-"]) for w in words))
    crcs, text, words = importance.features([t.encode() for t in texts])
    for i, t in enumerate(texts):
        own = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", t)
        expected = [zlib.crc32(f.encode()) for f in [*own, *map(" ".join, zip(own, own[1:]))]]
        assert sorted(crcs[text == i].tolist()) == sorted(expected) and words[i] == len(own)


def test_ranks_over_many_ranges(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") * 7919 % 50).alias("s"))
    got = importance.ranked(df, [F.col("s").desc(), F.col("id")]).collect()
    expected = sorted(got, key=lambda r: (-r["s"], r["id"]))
    assert [r["rank"] for r in expected] == list(range(1, 5001))


# 12: packing


def check_pieces(pieces, expected, capacity):
    """Each id in exactly one piece, cuts as stated, sequences gapless; ``expected`` is a list of (doc_id, ids)."""
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
    wanted = {}
    for i, ids in expected:
        first = len(ids) % capacity
        cuts = ([0] if first else []) + list(range(first, len(ids), capacity))
        ends = [*cuts[1:], len(ids)]
        crcs = [zlib.crc32(np.array(ids[a:b], "<u4").tobytes()) for a, b in zip(cuts, ends)]
        wanted.setdefault(i, []).extend((k, a, b - a, c) for k, (a, b, c) in enumerate(zip(cuts, ends, crcs)))
    assert {i: sorted(w) for i, w in wanted.items()} == {
        i: sorted((p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in ps) for i, ps in by_doc.items()
    }
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= capacity
    return sequences


def test_packing_holds_every_id_with_little_slack(spark):
    library = Tokenizer.from_file(BPE)
    rows = texts_of("documents")
    expected = [(r["doc_id"], [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]) for r in rows]
    sequences = check_pieces(queries.op12_best_fit_packing(spark, SF).collect(), expected, 1024)
    tokens = sum(len(ids) for _, ids in expected)
    assert len(sequences) <= math.ceil(tokens / 1024) * 1.01 + 1, len(sequences)


def test_packing_defined_cases(odd, empty):
    library = Tokenizer.from_file(BPE)
    expected = [(r["doc_id"], [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]) for r in odd.collect()]
    pieces = slack_packing.pack(odd, BPE).withColumn("ids_crc32", F.crc32("ids")).collect()
    check_pieces(pieces, expected, 1024)
    assert slack_packing.pack(empty, BPE).count() == 0


def test_fullest_equals_all_subsets():
    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.randint(1, 30) for _ in range(rng.randint(1, 11))]
        counts = Counter(sizes)
        chosen = slack_packing.fullest(sorted(counts, reverse=True), counts, 30)
        best = max(s for k in range(len(sizes) + 1) for c in combinations(sizes, k) if (s := sum(c)) <= 30)
        assert sum(chosen) == best and not Counter(chosen) - counts


def test_block_gives_each_item_once(monkeypatch):
    rng = random.Random(2)
    block = slack_packing.Block(1024)
    sizes = [rng.randint(1, 1023) for _ in range(3000)] + [1] * 5000
    for k, n in enumerate(sizes):
        block.add(n, (k, n))
    half = list(block.sequences(block.tokens // 2, block.size // 2))
    rest = list(block.sequences())
    assert sorted(k for s in half + rest for k, _ in s) == list(range(len(sizes)))
    assert all(1016 <= sum(n for _, n in s) <= 1024 for s in half)
    assert len(half) + len(rest) <= math.ceil(sum(sizes) / 1024) * 1.02


def test_token_ids_equal_the_library():
    own, library = byte_tokens.byte_tokens(BPE), Tokenizer.from_file(BPE)
    rng = random.Random(4)
    letters = "ab zÄß'sd\n\t 09.,\xa0Ɐ漢é<|>\x85\x1c"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["<|endoftext|>a", "x" * 20_000, " " * 9000 + "a", "\n" * 9000, "don't we'll  I've   x", LONG]
    for t in texts:
        assert own.ids(t) == np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


# 13: fill in the middle


def test_rewriting_defined_cases(odd, empty):
    got = fill_middle.fill_in_middle(odd).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    texts = Counter((r["doc_id"], r["text"] or "") for r in odd.collect())
    assert Counter((r["doc_id"], r["back"]) for r in got) == texts
    forms = {r["doc_id"]: r["form"] for r in got}
    assert forms[0] == forms[1] == forms[10] == "plain" and forms[3] != "plain"
    assert all((r["prefix_chars"] is None) == (r["form"] == "plain") for r in got)
    assert {r["n"] for r in got if r["doc_id"] == 9} == {70_001}
    assert fill_middle.fill_in_middle(empty).count() == 0
    assert {r["form"] for r in fill_middle.fill_in_middle(odd, rate=0).collect()} == {"plain"}


@pytest.mark.parametrize("share", [0.0001, 0.03, 0.5, 0.97])
def test_line_ends_in_every_kind_of_chunk(share):
    rng = np.random.default_rng(6)
    codes = np.where(rng.random(200_000) < share, ord("\n"), ord("é" if share < 0.4 else "e"))
    codes[70_000:140_000] = ord("\n") if share > 0.4 else ord("x")
    text = "".join(map(chr, codes.tolist()))
    ends = fill_middle.LineEnds(text)
    lines = re.findall("[^\\n]*\\n|[^\\n]+", text)
    assert len(ends) == len(lines)
    offsets = np.cumsum([0, *map(len, lines)])
    some = sorted({0, len(lines), *rng.integers(0, len(lines) + 1, 500).tolist()})
    assert [ends.after(k) for k in some] == offsets[some].tolist()


def test_all_kinds_of_chunk_are_met():
    hits = np.zeros(fill_middle.CHUNK, bool)
    hits[::50] = True
    assert isinstance(fill_middle.chunk(hits), fill_middle.Places)
    hits[::3] = True
    assert isinstance(fill_middle.chunk(hits), fill_middle.Bits)
    hits[:] = True
    assert isinstance(fill_middle.chunk(hits), fill_middle.Runs)


def test_marks_are_found_beside_broken_ones():
    for text in ("a<\nS>b\n<\nP>\nM>", "<\nM\n>", "P>\n<S\n<M\n<P"):
        for i in range(40):
            n, form, a, m, output = fill_middle.rewrite(i, text, 7, 100, 50)
            prefix, middle, suffix = text[:a], text[a : a + m], text[a + m :]
            assert output == ("<P>" + prefix + "<S>" + suffix if form == "psm" else "<S>" + suffix + "<P>" + prefix) + "<M>" + middle
