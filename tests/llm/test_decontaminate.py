import random

from quillspan.llm import decontaminate
from quillspan.llm.queries import QUERIES
from quillspan.llm.scratch import Scratch

DOCS, ITEMS = "doc_id long, text string, item_id long", "item_id long, text string"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain(docs, items):
    sets = [(i, shingles(t)) for i, t in items if i is not None]
    return sorted({(d, i, len(q), len(q & s)) for d, t in docs for s in [shingles(t)] for i, q in sets if q and 100 * len(q & s) >= 75 * len(q)}, key=str)


def run(spark, docs, items):
    found = decontaminate.contaminated(spark.createDataFrame([(*d, 5) for d in docs], DOCS).repartition(3), spark.createDataFrame(items, ITEMS), Scratch(spark, "t"))
    return sorted([(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in found.collect()], key=str)


def test_query_is_brute_force(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = sorted([(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in QUERIES["op3_decontaminate"](spark, sf_dir).collect()], key=str)
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]) and got


def test_partial_and_scattered_copies_in_long_texts(spark):
    pick = random.Random(4)
    word = lambda: f"w{pick.randrange(4000)}"
    items = [(i, " ".join(word() for _ in range(pick.randrange(3, 80)))) for i in range(30)]
    docs = []
    for d in range(120):
        words = [word() for _ in range(pick.choice([0, 5, 60, 3000]))]
        for _ in range(3):
            part = items[pick.randrange(30)][1].split()
            for _ in range(pick.randrange(0, 3)):
                part[pick.randrange(len(part))] = word()
            at = pick.randrange(len(words) + 1)
            words[at:at] = part[pick.randrange(0, 6) :]
        docs.append((d, " ".join(words)))
    docs.append((500, items[0][1].upper().replace(" ", "\n\t")))
    assert run(spark, docs, items) == plain(docs, items)


def test_nulls_short_items_repeats_and_empty_tables(spark):
    docs = [(1, None), (2, ""), (3, "a b"), (None, "p q r s t u"), (4, "p q r s t u"), (4, "p q r s t u"), (4, "other"), (5, "a b c d e f " * 20_000)]
    items = [(1, None), (2, ""), (3, "A b"), (None, "p q r s t"), (4, "p q r s t"), (4, "p q r s t"), (5, "a b c d e f")]
    assert run(spark, docs, items) == plain(docs, items)
    assert run(spark, docs[:0], items) == [] and run(spark, docs, items[:0]) == []


def test_stage_drops_just_those(spark):
    docs = spark.createDataFrame([(1, "x p q r s t y", "k"), (2, "clean", None), (None, "p q r s t", "n"), (3, None, "z")], "doc_id long, text string, _d string")
    left = decontaminate.drop_contaminated(docs, spark.createDataFrame([(1, "p q r s t")], ITEMS), Scratch(spark, "t"))
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 3]


def test_more_sketches_than_may_be_broadcast(spark, sf_dir, monkeypatch):
    want = sorted(map(tuple, QUERIES["op3_decontaminate"](spark, sf_dir).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, QUERIES["op3_decontaminate"](spark, sf_dir).collect())) == want
