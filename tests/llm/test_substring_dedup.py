import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quillspan.llm import substring_dedup
from quillspan.llm.queries import QUERIES
from quillspan.llm.scratch import Scratch


def plain(rows, length=200):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i] += 1
                if i + length <= len(t):
                    gone[i + length] -= 1
        mask = np.cumsum(gone)[: len(t)] > 0
        starts = int((mask & ~np.append(False, mask[:-1])).sum()) if len(t) else 0
        kept = bytes(np.frombuffer(t, np.uint8)[~mask])
        out.append((d, len(t), int(mask.sum()), starts, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **options):
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, a long, spans string").repartition(3)
    got = substring_dedup.remove_repeats(docs, Scratch(spark, "t"), **options).collect()
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got], key=str)


def test_query_is_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = QUERIES["op9_substring_dedup"](spark, sf_dir).collect()
    assert sorted(map(tuple, got), key=str) == plain([(r.doc_id, r.text) for r in docs])


@pytest.mark.parametrize("seed", range(3))
def test_passages_of_all_lengths_and_places(spark, seed):
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abcdé") for _ in range(pick.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(pick.randrange(8, 30)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [text(pick.randrange(0, 20)) for _ in range(4)]
        for _ in range(3):
            s = pick.choice(shared)
            a = pick.randrange(len(s))
            parts.insert(pick.randrange(len(parts)), s[a : a + pick.randrange(20, 120)])
        rows.append((i, " ".join(parts)))
    rows += [(100, "ab" * 300), (101, "x" + "ab" * 200), (102, "q" * 500), (103, "line of text\n" * 40), (104, rows[0][1]), (105, rows[0][1][7:])]
    assert run(spark, rows, length=40, grams=(20, 30, 40)) == [x for x in plain(rows, 40)]


def test_nulls_short_and_very_long_texts_and_repeated_rows(spark):
    pick = random.Random(9)
    long_ = "".join(chr(97 + pick.randrange(26)) for _ in range(2_100_000))
    rows = [(1, None), (2, ""), (3, "a" * 199), (4, "a" * 199), (5, "b" * 200), (5, "b" * 200), (None, "c" * 201), (7, long_), (8, long_[899_700:900_500]), (None, "é" * 100), (9, "é" * 100)]
    assert run(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert run(spark, []) == []
