"""The near-copy stage of the pipeline against brute force over five-word shingles."""

import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from usage_ts.llm import shingle_links, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_shingles(text):
    words = (text or "").lower().split(" ")
    words = [w for part in words for w in part.split()]
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def parts(n, linked):
    of = list(range(n))
    for i in range(n):
        for j in range(i):
            if of[i] != of[j] and linked(i, j):
                of = [of[j] if p == of[i] else p for p in of]
    return of


def kept_by_hand(rows):
    sets = [plain_shingles(t) for _, t in rows]
    fps = [simhash.fingerprint(t) for _, t in rows]
    of = parts(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3 or jaccard(sets[i], sets[j]) >= 0.8)
    return {min(rows[i][0] for i in range(len(rows)) if of[i] == p) for p in set(of)}


def stage(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    return corpus_pipeline.near_copies(spark, docs, "")


def test_near_copies_of_real_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()]
    got = {r["doc_id"] for r in stage(spark, rows).collect()}
    assert got == kept_by_hand(rows)
    assert not {255, 770} & got  # 0.83 and 0.84 similar to 1 and 643, at more than three bits


@pytest.mark.parametrize("block", [1_000_000, 600])
def test_chains_and_blocks(spark, monkeypatch, block):
    """Similar only to the next one, to an outsider or to none; the same with groups cut into many blocks."""
    monkeypatch.setattr(shingle_links, "BLOCK", block)
    rng = np.random.default_rng(5)
    rows = []
    for g in range(4):
        words = [f"g{g}w{k}" for k in range(120)]
        for step in range(25):
            rows.append((len(rows), " ".join(words)))
            at = int(rng.integers(0, 110))
            words[at : at + 1 + g * 3] = [f"g{g}s{step}x{k}" for k in range(1 + g * 3)]
    rows += [(len(rows) + k, t) for k, t in enumerate([None, "", "a b", "A  b", "a b c", *(f"lone {k} text of six words {k}" for k in range(9))])]
    got = {r["doc_id"] for r in stage(spark, rows).collect()}
    assert got == kept_by_hand(rows)
    assert len(got) < len(rows) / 2


def test_shared_and_missing_ids(spark):
    one, two, three = (" ".join(f"{c}{k}" for k in range(60)) for c in "abc")
    rows = [(7, one), (7, two), (7, two), (8, one + " x"), (None, one + " y"), (None, three), (None, three), (None, three.upper()), (9, two)]
    got = [(r["doc_id"], r["text"].lower()) for r in stage(spark, rows).collect()]
    assert sorted(got, key=str) == sorted([(7, one), (7, two), (None, three)], key=str)
