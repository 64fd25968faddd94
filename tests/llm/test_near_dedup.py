import random
import re

from quillspan.llm import near_dedup
from quillspan.llm.components import components
from quillspan.llm.queries import QUERIES
from quillspan.llm.scratch import Scratch


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def plain(rows):
    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    up = {d: d for d, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if (n := len(x & y)) and 100 * n >= 75 * len(x | y):
                p, q = sorted((top(a), top(b)))
                up[q] = p
    return sorted((d, len(shingles(t)), top(d) if d is not None else None, d is None or top(d) == d) for d, t in rows)


def run(spark, rows, **options):
    docs = spark.createDataFrame([(d, t, "z", 1) for d, t in rows], "doc_id long, text string, bands string, kept int")
    return sorted(map(tuple, near_dedup.near_duplicates(docs, Scratch(spark, "t"), **options).collect()))


def test_query_is_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = QUERIES["op2_minhash_near_dedup"](spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == plain([(r.doc_id, r.text) for r in docs])


def test_chains_copies_and_borderline_pairs(spark):
    pick = random.Random(3)
    rows, n = [], 0
    for _ in range(12):
        words = [f"w{pick.randrange(10**6)}" for _ in range(pick.randrange(20, 90))]
        for _ in range(10):
            n += 1
            rows.append((n, " ".join(words)))
            words = list(words)
            words[pick.randrange(len(words))] = f"w{pick.randrange(10**6)}"
    rows += [(n + 1 + i, rows[0][1].upper().replace(" ", "\t\n")) for i in range(40)]
    pick.shuffle(rows)
    assert run(spark, rows) == plain(rows)


def test_nulls_short_texts_and_words_of_other_scripts(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "a b"), (5, "A  b"), (6, "a b c d e"), (7, "a b c d\u00a0e"), (8, "É x"), (9, "é x"), (10, "x " * 50_000), (11, "x x x x x")]
    assert run(spark, rows) == plain(rows)


def test_null_and_repeated_ids(spark):
    got = run(spark, [(1, "a b c"), (1, "a b c"), (2, "A b c")])
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)]
    docs = spark.createDataFrame([(None, "a b c"), (4, "a b c")], "doc_id long, text string")
    assert {tuple(r) for r in near_dedup.near_duplicates(docs, Scratch(spark, "t")).collect()} == {(None, 1, None, True), (4, 1, 4, True)}


def test_one_of_each_group_stays(spark):
    docs = spark.createDataFrame([(3, "a b c", "s"), (1, "a b c", "t"), (1, "a b c", "t"), (None, "a b c", "u"), (2, "other", None)], "doc_id long, text string, lang string")
    kept = near_dedup.drop_near_duplicates(docs, Scratch(spark, "t"))
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, "a b c", "t"), (None, "a b c", "u"), (2, "other", None)], key=str)


def test_texts_of_one_id_are_judged_apart(spark):
    """Rows that repeat an id with other texts stay, unless they are like a row that comes before them."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near = a.replace("a59", "zz")
    stage = lambda rows: sorted(map(tuple, near_dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t")).collect()))
    assert stage([(1, a), (1, b), (2, a), (3, c)]) == sorted([(1, a), (1, b), (3, c)])
    got = stage([(1, a), (4, near), (4, c), (4, c), (5, b), (5, b.upper())])
    assert len(got) == 3 and got[:2] == [(1, a), (4, c)] and got[2] in ((5, b), (5, b.upper()))
    assert len(stage([(7, a), (7, near)])) == 1
    clashing = spark.createDataFrame([(1, a, "x", 5), (2, a, "y", 6)], "doc_id long, text string, _d string, text_key int")
    got = near_dedup.drop_near_duplicates(clashing, Scratch(spark, "t"))
    assert got.columns == clashing.columns and [tuple(r) for r in got.collect()] == [(1, a, "x", 5)]


def test_empty_table(spark):
    assert run(spark, []) == []


def test_components_of_random_graphs(spark):
    pick = random.Random(5)
    edges = [(pick.randrange(300), pick.randrange(300)) for _ in range(240)] + [(1000 + i, 1001 + i) for i in range(70)]
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = sorted((top(a), top(b)))
        up[q] = p
    got = {r.u: r.v for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    assert got == {x: top(x) for x in up if top(x) != x}
