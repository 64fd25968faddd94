"""Top-k search, routing to collections, and what is done with the hits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import vectors as V
from quillspan.operators import blocks as B
from quillspan.operators import chunks as C

NO_CONTEXT, APOLOGY = "no context", "sorry, no answer"
#: Scores are compared to so many places, so that equal vectors tie whichever way they were multiplied; six are shown.
PLACES = 12
#: Rows of the base in a cell of a search with many queries.
CELL = 20_000
#: An approximate search: the most centroids, rows that they are drawn from, rounds of means, and queries on which the probes are measured.
CENTROIDS, SAMPLE, MEANS, MEASURED = 4096, 32_768, 8, 256


def top_k(base: DataFrame, query: list[float], k: int, metric: str = "cosine") -> DataFrame:
    """The ``k`` nearest rows of (id, vector) to one query vector, ties by id. No full sort."""
    q = F.array(*map(F.lit, query))
    if metric == "cosine":
        found = base.withColumn("score", F.round(V.cosine(F.col("vector"), q), PLACES)).orderBy(F.desc("score"), "id")
    else:
        found = base.withColumn("score", F.round(V.squared_distance(F.col("vector"), q), PLACES)).orderBy("score", "id")
    return found.limit(k).drop("vector").withColumn("score", F.round("score", 6))


def knn_join(queries: DataFrame, base: DataFrame, k: int, block: int = 4096, by: str | None = None) -> DataFrame:
    """(query_id, id, score, rank): for every query (query_id, vector) the ``k`` nearest rows of
    (id, vector) by cosine, ties by id; with ``by``, among the rows of the query's own group.

    Null vectors and ids take no part, and vectors meet those of their own length only. Up to ``block``
    queries go to the tasks, each of which multiplies its rows with those of their group and keeps ``k``
    for each query; only these are shuffled. More queries than that are never in one place: they and the base are dealt to
    cells of about ``block`` queries and ``CELL`` rows of one group and length."""
    keys = [by] if by else []
    asked = queries.where("query_id is not null and vector is not null").select("query_id", "vector", *keys)
    rows = base.where("id is not null and vector is not null").select("id", "vector", *keys)
    if by:
        asked = asked.where(F.col(by).isNotNull())
    few = asked.limit(block + 1).collect()
    schema = f"query_id {dict(queries.dtypes)['query_id']}, id {dict(base.dtypes)['id']}, score double"
    found = _broadcast_search(few, rows, k, by, schema) if len(few) <= block else _cell_search(asked, rows, k, by, block, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("score", F.round("score", 6))


def _broadcast_search(few: list, rows: DataFrame, k: int, by: str | None, schema: str) -> DataFrame:
    tables: dict[tuple, list] = {}
    for r in few:
        tables.setdefault((len(r.vector), r[by] if by else None), []).append(r)
    made = {key: (np.array([r.query_id for r in own], object), _unit(np.array([r.vector for r in own], float).reshape(len(own), -1))) for key, own in tables.items()}
    groups = {g for _, g in made}
    if by and len(groups) <= 1000:  # reaches the scan, so that a store's other folders aren't read
        rows = rows.where(F.col(by).isin(*groups)) if groups else rows.limit(0)
    spread = rows.sparkSession.sparkContext.broadcast(made)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[pd.DataFrame] = []
        for frame in frames:
            for key, own in frame.groupby([frame["vector"].map(len), *([frame[by]] if by else [])], sort=False):
                found = spread.value.get((key[0], key[1] if by else None))
                if found is not None:
                    best.append(_nearest(*found, own, k))
            if len(best) > 8:
                best = [_kept(best, k)]
        if best:
            yield _kept(best, k)

    return rows.mapInPandas(run, schema)


def _cell_search(asked: DataFrame, rows: DataFrame, k: int, by: str | None, block: int, schema: str) -> DataFrame:
    group = F.col(by).cast("string") if by else F.lit("")
    sides = {}
    for name, df, id_, size in (("q", asked, "query_id", block), ("b", rows, "id", CELL)):
        own = df.select(F.size("vector").alias("dim"), group.alias("g"), F.col(id_).alias(f"{name}_id"), F.col("vector").alias(f"{name}_vector"))
        parts = own.groupBy("dim", "g").agg(F.ceil(F.count("*") / size).cast("int").alias(f"{name}_parts"))
        sides[name] = own, parts
    parts = sides["q"][1].join(sides["b"][1], ["dim", "g"])
    q = sides["q"][0].join(parts, ["dim", "g"]).withColumn("q_part", F.pmod(F.xxhash64("q_id"), F.col("q_parts")).cast("int"))
    b = sides["b"][0].join(parts, ["dim", "g"]).withColumn("b_part", F.pmod(F.xxhash64("b_id"), F.col("b_parts")).cast("int"))
    q = q.withColumn("b_part", F.explode(F.sequence(F.lit(0), F.col("b_parts") - 1))).drop("q_parts", "b_parts")
    b = b.withColumn("q_part", F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1))).drop("q_parts", "b_parts")
    cell = ["dim", "g", "q_part", "b_part"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        ids, matrix = left["q_id"].to_numpy(object), _unit(np.stack(left["q_vector"].to_numpy()).astype(float))
        right = right[["b_id", "b_vector"]].set_axis(["id", "vector"], axis=1)
        return _kept([_nearest(ids, matrix, right.iloc[i : i + 2048], k) for i in range(0, len(right), 2048)], k)

    return q.groupBy(*cell).cogroup(b.groupBy(*cell)).applyInPandas(run, schema)


def knn_approximate(queries: DataFrame, base: DataFrame, k: int, target: float = 0.93, probes: int | None = None, by: str | None = None, block: int = 4096) -> DataFrame:
    """As :func:`knn_join`, but each query meets only the rows of the cells nearest to it, exactly; about ``target`` of the true
    nearest rows are found.

    Rows lie in the cell of the nearest of about the root of their number of centroids (:data:`CENTROIDS` at most), which are means of a
    sample of :data:`SAMPLE` rows; every row is indexed. How many cells a query probes is measured, unless ``probes`` says so: an
    exact search for up to :data:`MEASURED` queries, one pass over the base, shows in which of a query's cells its nearest rows
    lie. A row is shuffled once for every ``block`` queries of its cell, a query once for every ``CELL`` rows of each cell it probes: both grow as
    their own side does. Null vectors and ids take no part, and vectors meet those of their own length only."""
    keys = [by] if by else []
    asked = queries.where("query_id is not null and vector is not null").select("query_id", "vector", *keys)
    rows = base.where("id is not null and vector is not null").select("id", "vector", *keys)
    if by:
        asked, rows = asked.where(F.col(by).isNotNull()), rows.where(F.col(by).isNotNull())
    schema = f"query_id {dict(queries.dtypes)['query_id']}, id {dict(base.dtypes)['id']}, score double"
    centroids = _centroids(rows)
    if probes is None:
        few = asked.orderBy(F.xxhash64("query_id"), "query_id").limit(MEASURED).collect()
        probes = _probes(few, rows, k, by, schema, centroids, target)
    group = F.col(by).cast("string") if by else F.lit("")
    at = lambda cell: F.concat(group, F.lit(":"), cell.cast("string"))
    cells = _cells(centroids, probes)
    asked = asked.withColumn("_cell", F.explode(cells(F.col("vector")))).select("query_id", "vector", at(F.col("_cell")).alias("_cell"))
    rows = rows.select("id", "vector", at(F.get(_cells(centroids, 1)(F.col("vector")), 0)).alias("_cell"))
    found = _cell_search(asked, rows, k, "_cell", block, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("score", F.round("score", 6))


def _centroids(rows: DataFrame) -> dict[int, np.ndarray]:
    """Unit centroids of each vector length of the base: means of a sample drawn by a hash of the ids."""
    sizes = {r.dim: r.n for r in rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(16).collect() if r.dim}
    out = {}
    for dim, n in sizes.items():
        share = min(1.0, SAMPLE / n)
        drawn = F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(1 << 20)) < int(share * (1 << 20))
        own = rows.where((F.size("vector") == dim) & drawn).select("id", "vector").limit(2 * SAMPLE).collect()
        x = _unit(np.array([r.vector for r in sorted(own, key=lambda r: r.id)], float).reshape(len(own), dim))
        x = x[np.isfinite(x).all(axis=1)]
        c = min(CENTROIDS, max(1, int(n**0.5)), len(x))
        if not c:
            continue
        means = x[np.linspace(0, len(x) - 1, c).astype(int)]
        for _ in range(MEANS):
            own_ = (x @ means.T).argmax(axis=1)
            order = np.argsort(own_, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(own_[order]) > 0))
            means = means.copy()
            means[own_[order][first]] = _unit(np.add.reduceat(x[order], first, axis=0))
        out[dim] = means
    return out


def _ranked(centroids: dict[int, np.ndarray], vectors: list, most: int) -> list[list[int]]:
    """The numbers of each vector's ``most`` nearest centroids, nearest first; lengths without centroids are one cell."""
    out: list[list[int]] = [[0]] * len(vectors)
    sizes = np.array([len(v) for v in vectors])
    for dim in np.unique(sizes).tolist():
        if dim in centroids:
            at = np.flatnonzero(sizes == dim)
            near = np.nan_to_num(_unit(np.array([vectors[i] for i in at], float)) @ centroids[dim].T)
            n = min(most, near.shape[1])
            best = np.argpartition(-near, n - 1, axis=1)[:, :n] if n < near.shape[1] else np.broadcast_to(np.arange(n), near.shape)
            order = np.take_along_axis(best, np.argsort(-np.take_along_axis(near, best, 1), axis=1, kind="stable"), 1)
            for i, own in zip(at.tolist(), order.tolist(), strict=True):
                out[i] = own
    return out


def _cells(centroids: dict[int, np.ndarray], most: int) -> Callable[[Column], Column]:
    @F.pandas_udf("array<int>")
    def run(vectors: pd.Series) -> pd.Series:
        return pd.Series([own for i in range(0, len(vectors), 1024) for own in _ranked(centroids, list(vectors[i : i + 1024]), most)], dtype=object)

    return run


def _probes(few: list, rows: DataFrame, k: int, by: str | None, schema: str, centroids: dict[int, np.ndarray], target: float) -> int:
    """The least number of cells in which ``target`` of the nearest rows of ``few`` queries lie."""
    found = _broadcast_search(few, rows, k, by, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    pairs = rows.select("id", "vector").join(F.broadcast(best.select("query_id", "id")), "id").collect()  # ``k`` rows for each of ``few`` queries
    asked = {r.query_id: r.vector for r in few}
    all_ = _ranked(centroids, list(asked.values()), CENTROIDS)
    place = {q: {c: i for i, c in enumerate(own)} for q, own in zip(asked, all_, strict=True)}
    cells = _ranked(centroids, [r.vector for r in pairs], 1)
    deep = sorted(place[r.query_id].get(c[0], 0) for r, c in zip(pairs, cells, strict=True))
    return deep[min(len(deep) - 1, int(np.ceil(target * len(deep))))] + 1 if deep else 1


def _nearest(ids: np.ndarray, matrix: np.ndarray, frame: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` best rows of a frame for each query."""
    score = np.round(_unit(np.stack(frame["vector"].to_numpy()).astype(float)) @ matrix.T, PLACES)
    own = frame["id"].to_numpy()
    place = np.argsort(np.argsort(own, kind="stable"), kind="stable")
    order = np.lexsort((np.broadcast_to(place[:, None], score.shape), -score), axis=0)[:k]
    return pd.DataFrame({"query_id": np.repeat(ids[None, :], len(order), 0).ravel(), "id": own[order].ravel(), "score": np.take_along_axis(score, order, 0).ravel()})


def _kept(parts: list[pd.DataFrame], k: int) -> pd.DataFrame:
    whole = pd.concat(parts)
    whole = whole[np.isfinite(whole["score"])].sort_values(["query_id", "score", "id"], ascending=[True, False, True])
    return whole.groupby("query_id").head(k)


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(size > 0, size, 1)


def route_query(queries: DataFrame, registry: DataFrame, least: float = 0.5) -> DataFrame:
    """(query_id, table_id, sim): the collection whose description is nearest, if at least ``least``; else null.

    As :func:`knn_join`, so that no queries or an empty registry give no route; ties by id."""
    near = knn_join(queries, registry.withColumnRenamed("table_id", "id"), 1).where(F.col("score") >= least)
    best = near.select("query_id", F.col("id").alias("table_id"), F.col("score").alias("sim"))
    return queries.select("query_id").join(best, "query_id", "left")


def gate_long_text(docs: DataFrame, query: str, k: int = 3, longest: int = 6000, least: int = 60, most: int = 200, embed: Callable[[pd.Series], np.ndarray] = V.hash_embed) -> DataFrame:
    """(doc_id, chunk_no, content) of (doc_id, text), without ``----``: texts of up to ``longest`` characters whole,
    of others the ``k`` chunks nearest to ``query``, ties by chunk_no. A null text isn't passed on."""
    docs = docs.where("text is not null").select("doc_id", F.replace("text", F.lit("----"), F.lit("")).alias("text"))
    short = docs.where(F.length("text") <= longest).select("doc_id", F.lit(0).alias("chunk_no"), F.col("text").alias("content"))
    q = F.array(*map(F.lit, embed(pd.Series([query]))[0].tolist()))
    chunks = C.build_chunks(B.line_block_lists(docs.where(F.length("text") > longest)), least=least, most=most)
    score = F.round(F.coalesce(V.cosine(V.embed(F.col("content"), embed), q), F.lit(0.0)), PLACES)
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "chunk_no")
    near = chunks.withColumn("score", score).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    return short.unionByName(near.select("doc_id", "chunk_no", "content"))


def format_hits(hits: DataFrame) -> DataFrame:
    """(query_id, context) from (query_id, rank, file_name, title_path, content): headers are left out where empty."""
    head = F.when(F.coalesce("file_name", F.lit("")) != "", F.concat(F.lit("以下内容来自文档《"), "file_name", F.lit("》：\n\n"))).otherwise("")
    path = F.when(F.size("title_path") > 0, F.concat(F.lit("章节路径："), F.array_join("title_path", " > "), F.lit("\n\n"))).otherwise("")
    return joined(hits.withColumn("content", F.concat(head, path, F.lit("正文内容："), "content")), "context")


def joined(hits: DataFrame, name: str, separator: str = "\n----\n") -> DataFrame:
    parts = F.transform(F.sort_array(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"])
    return hits.groupBy("query_id").agg(F.array_join(parts, separator).alias(name))


def graded_context(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits graded yes, in rank order; an empty text for queries without any."""
    return queries.select("query_id").join(joined(hits.where("grade = 'yes'"), "context"), "query_id", "left").fillna({"context": ""})


def split_context(rows: DataFrame, separator: str = "----") -> DataFrame:
    return rows.select("query_id", F.posexplode(F.split("context", separator)).alias("part_no", "part"))


def next_after_grade(rewrite_num: Column, content: Column) -> Column:
    return F.when((rewrite_num >= 2) | (F.coalesce(content, F.lit("")) != ""), "generate").otherwise("rewrite")


def answer_context(rewrite_num: Column, regenerate_num: Column, content: Column) -> Column:
    return F.when(regenerate_num >= 2, APOLOGY).when(rewrite_num < 2, content).otherwise(NO_CONTEXT)


def next_after_answer(rewrite_num: Column, regenerate_num: Column, support: Column, answer: Column) -> Column:
    return F.when(regenerate_num >= 2, "useful").when((rewrite_num < 2) & (support != "yes"), "not_supported").when(answer == "yes", "useful").otherwise("not_useful")


def next_after_rewrite(rewrite_num: Column, grade: Column) -> Column:
    return F.when((grade == "yes") | (rewrite_num > 2), "agent").otherwise("rewrite")


def run_outcomes(runs: DataFrame) -> DataFrame:
    """Counts by rewrite number and outcome, with totals (nulls)."""
    outcome = next_after_answer(F.col("rewrite_num"), F.col("regenerate_num"), F.col("support_grade"), F.col("answer_grade"))
    return runs.withColumn("outcome", outcome).rollup("rewrite_num", "outcome").agg(F.count("*").alias("n"))
