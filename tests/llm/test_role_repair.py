import hashlib
import itertools
import random
import re
import zlib

from quillspan.llm import role_repair as R
from quillspan.llm.queries import QUERIES
from quillspan.llm.scratch import Scratch

SCHEMA = "conv_id long, turn long, role string, text string, place string, edit string, conv string"


def cheapest(rows):
    """The least (cost, audit) of all ways to edit (initial, fault) rows, by search over edits with up to four insertions."""
    best = None

    def go(i, cost, audit, roles):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best or (10**9, ""), (cost, audit))
        if audit.count("I") < 4:
            for t in "ua":
                go(i, cost + 5, audit + "I", roles + t)
        if i < len(rows):
            initial, fault = rows[i]
            go(i + 1, cost + 2, audit + "D", roles)
            if fault not in (1, 2):
                more = 5 if fault == 3 else 0
                go(i + 1, cost + more, audit + "K", roles + initial)
                for t in "ua":
                    go(i + 1, cost + 1 + more, audit + "R", roles + t)

    go(0, 0, "", "")
    return best


def charted(rows):
    chart = R.Chart()
    for r in rows:
        chart.read(*r)
    cost, edits, last = chart.repair()
    return cost, "".join(edits) + "I" * last


def test_chart_finds_the_cheapest_least_edits():
    rng = random.Random(3)
    for n in range(4):
        for roles in itertools.product("suax", repeat=n):
            rows = [(r, rng.choice((0, 0, 0, 1, 2, 3))) for r in roles]
            assert charted(rows) == cheapest(rows), rows
    for _ in range(150):
        rows = [(rng.choice("suuaax "), rng.choice((0, 0, 0, 3, 1))) for _ in range(rng.randint(4, 6))]
        assert charted(rows) == cheapest(rows), rows


def test_chart_is_linear():
    assert charted([("u", 0)] * 4000) == (2000, "KR" * 2000)
    assert charted([]) == (0, "")


def expected(rows):
    """What the query says of undamaged (conv_id, turn, role, text) rows, in plain Python."""
    out = {}
    for conv in dict.fromkeys(r[0] for r in rows):
        own = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            case = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
            own += [(turn, "user" if case == 4 else role, text)] * {0: 0, 3: 2}.get(case, 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in own:
            solid = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append(1 if not solid else 2 if (role, text) in seen else 3 if solid[-1] not in ".!?" else 0)
            seen.add((role, text))
        cost, audit = charted([(r[1][:1], f) for r, f in zip(own, faults, strict=True)])
        said, before, i = [], "", 0
        for x in audit:
            role, text = ("", "") if x == "I" else own[i][1:]
            i += x != "I"
            if x == "D":
                continue
            before = role[:1] if x == "K" else "a" if before == "u" else "u"
            said.append(f"{role if x == 'K' else R.MADE[before]}:{text}")
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        out[conv] = (gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def query(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "p", "e", "c") for r in rows], SCHEMA).write.mode("overwrite").parquet(str(tmp_path / "conversations.parquet"))
    got = QUERIES["op13_role_repair"](spark, str(tmp_path)).collect()
    assert len(got) == len({r[0] for r in rows})
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}


def test_query_against_plain_python(spark, tmp_path):
    rng = random.Random(11)
    texts = ["Yes.", "No!", "and then", " ", "", None, "Why?\n", "x" * 20_000 + ".", "Yes."]
    roles = ["user", "assistant", "system", "tool", None, "user", "assistant"]
    rows = [(c if c else None, None if rng.random() < 0.1 else rng.randint(0, 12), rng.choice(roles), rng.choice(texts)) for c in range(60) for _ in range(rng.randint(1, 9))]
    rows += [rows[0]] * 3 + [(1000, i, "user" if i % 2 else "assistant", f"Line {i % 50}.") for i in range(600)]
    assert query(spark, tmp_path, rows) == expected(rows)


def test_conversation_of_which_nothing_is_left(spark, tmp_path):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert query(spark, tmp_path, [(gone, 0, "user", "Hi.")]) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert query(spark, tmp_path, []) == {}


def test_transcript(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "assistant", "Well?"), (2, 0, "user", "Only.")]
    transcript, found = R.repair(spark.createDataFrame([(*r, "p", "e", "c") for r in rows], SCHEMA), Scratch(spark, "t"))
    own = [(r.conv_id, r.edit, r.turn, r.role, r.text, r.fault) for r in transcript.orderBy("conv", "place", "step").collect()]
    assert own == [
        (1, "D", 0, "assistant", "Hello.", 0), (1, "K", 1, "user", "Hi.", 0), (1, "D", 2, "user", "Hi.", 2), (1, "K", 3, "assistant", "Well?", 0),
        (2, "D", 0, "user", "Only.", 0),
    ]
    assert {r.conv_id: (r.cost, r.audit) for r in found.collect()} == {1: (4, "DKDK"), 2: (2, "D")}
    long = [(1, 0, "user", "a."), *((1, i, "assistant", f"{i}.") for i in range(1, 4)), (1, 5, "assistant", "e.")]
    t, _ = R.repair(spark.createDataFrame([(*r, "p", "e", "c") for r in long], SCHEMA), Scratch(spark, "t"))
    said = [(r.role, r.text) for r in t.where("edit <> 'D'").orderBy("place", "step").collect()]
    assert [x[0] for x in said] == ["user", "assistant"] * (len(said) // 2)
