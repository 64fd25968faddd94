"""Every registered query of the base library runs; those with a SQL twin agree with it."""

import datetime as dt
import decimal
import math

import duckdb
import pytest

import __spark_entry__
from quillspan.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, bool | str):
        return v
    if isinstance(v, int | float | decimal.Decimal):
        return round(float(v), 6) if not math.isnan(v) else None
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return str(v)


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in got.fetchall()), key=str)
    have = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    assert have == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_others_run(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "context"] and df.count() > 0


def test_twins_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_paragraphs_hold_the_whole_text(spark, tmp_path):
    """No box and no half of a line is left out, by the twin neither: lines of one letter, of signs beyond 16 bits, blank ones and pages of them."""
    lines = [f"{'line ' * (i % 7)}{i}{'.,?:。 '[i % 6]}" for i in range(95)]
    texts = ["\n".join(lines), "\n \n".join(lines[:41]), "a", "a\nb", " x \n\n y?\n z", "𝒳𝒴𝒵\n中文。字\né", "\n".join("abc" for _ in range(40)), "", " \n", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["merge_paragraphs"](spark, str(tmp_path))
    signs = {d: [] for d in range(len(texts))}
    for r in got.collect():
        signs[r.doc_id] += r.text
    assert {d: sorted("".join(x).replace(" ", "")) for d, x in signs.items()} == {d: sorted("".join((t or "").split())) for d, t in enumerate(texts)}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLE_SQL['merge_paragraphs']})").fetchall()
    assert sorted(tuple(map(plain, r)) for r in got.collect()) == sorted(tuple(map(plain, r)) for r in want)
