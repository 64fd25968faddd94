"""Registered queries of the operators in this subpackage, with production parameters
over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import (
    audio, decontaminate, delta_lloyd, language_id, language_model, mixing, near_dedup, role_repair, substring_dedup, token_blocks, token_counts,
    url_filter, warc,
)
from quillspan.llm.scratch import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(spark, table(spark, sf_dir, "documents"), "op1", units=700_000)


def token_digest(spark: SparkSession, docs: DataFrame, job: str, **options) -> DataFrame:
    """Write ``docs`` as token blocks, read them back, and give each document's place and checksum."""
    path = Scratch(spark, job).path("tokens")
    token_blocks.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), **options)
    return token_blocks.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "op3"))
    return found.select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), Scratch(spark, "op4"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op5_audio_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings that play the vectors of ``embeddings``: every row's class (``member``), and of the ids
    divisible by 20 the alignments with all classes, of the recording itself with others (``aligned``)
    and of an excerpt of it, begun anywhere and with noise, also with its own (``heard``)."""
    media = audio.sonified(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("values")))
    asked = media.where("id % 20 = 0")
    excerpts = audio.heard(asked).withColumn("id", -1 - F.col("id"))
    members, found = audio.align(audio.fingerprints(media), audio.fingerprints(asked.unionByName(excerpts), audio.PHASES), Scratch(spark, "op5"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("phase", "int"), ("offset", "int"), ("votes", "long"), ("overlap", "long"), ("bit_errors", "long"))]
    members = members.select(F.lit("member").alias("kind"), F.col("rep").alias("vec_id"), F.col("id").alias("other_id"), *none)
    kind, own = F.when(F.col("id") < 0, "heard").otherwise("aligned"), F.when(F.col("id") < 0, -1 - F.col("id")).otherwise(F.col("id"))
    return members.unionByName(found.select(kind.alias("kind"), own.alias("vec_id"), F.col("other").alias("other_id"), "phase", "offset", "votes", "overlap", "bit_errors"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, Scratch(spark, "op6"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "op2"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"), Scratch(spark, "op7"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"), Scratch(spark, "op8"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), Scratch(spark, "op9"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "op10").path("warc")
    warc.write_pages(table(spark, sf_dir, "pages"), path)
    found = warc.read(spark, path, "record_id", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload")
    # Of a response what counts is the payload as it was read back; a revisit carries none, and its headers tell.
    n, digest = F.octet_length("payload").cast("long"), warc.base32_of(F.sha1("payload"))
    found = found.withColumns({"payload_bytes": F.coalesce(n, "payload_bytes"), "payload_digest": F.coalesce(digest, "payload_digest")})
    return found.select(warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of(F.col("refers_to")).alias("refers_to"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op11")
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), scratch.path("cache"), scratch, units=700_000)
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def op12_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = delta_lloyd.cluster(table(spark, sf_dir, "embeddings"), Scratch(spark, "op12"))
    # One row for each centroid, so many as the parameter says.
    sums = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    rows = [(c, sums.get(c, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids)]
    own = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(own), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    transcript, found = role_repair.repair(role_repair.damage(rows), Scratch(spark, "op13"))
    hashes = role_repair.transcript_sha256(transcript)
    all_ = rows.select(F.col("conv_id").cast("long")).distinct().withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    out = all_.join(found.drop("conv_id"), "conv", "left").join(hashes, "conv", "left")
    longs = (F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return out.select("conv_id", *longs, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_token_blocks": op1_token_blocks,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_mix_sources": op4_mix_sources,
    "op5_audio_fingerprints": op5_audio_fingerprints,
    "op6_url_filter": op6_url_filter,
    "op7_language_model": op7_language_model,
    "op8_language_id": op8_language_id,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_warc": op10_warc,
    "op11_token_counts": op11_token_counts,
    "op12_delta_lloyd": op12_delta_lloyd,
    "op13_role_repair": op13_role_repair,
}


def lloyd_sql(clusters: int = 8, rounds: int = 10) -> str:
    """The rounds written out, each over all vectors."""
    ctes = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(1024 * x)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS c, x FROM v QUALIFY c < {clusters})",
    ]
    for i in range(rounds + 1):
        ctes.append(f"""a{i} AS MATERIALIZED (SELECT r, vec_id, any_value(x) AS x, min(d * {clusters} + c) % {clusters} AS c, min(d * {clusters} + c) // {clusters} AS d
  FROM (SELECT r, vec_id, v.x, c, list_sum(list_transform(list_zip(v.x, k.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{i} k) GROUP BY r, vec_id)""")
        if i < rounds:
            ctes.append(f"""c{i + 1} AS MATERIALIZED (SELECT k.c, coalesce(m.x, k.x) AS x FROM c{i} k LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS x
  FROM (SELECT c, j, sum(y)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(x) AS y, generate_subscripts(x, 1) AS j FROM a{i}) GROUP BY c, j) GROUP BY c) m ON m.c = k.c)""")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT a.vec_id, a.c::INTEGER AS cluster, a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(k.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} k ON k.c = a.c"""


def repair_sql() -> str:
    """Best (cost, edits) of each state after each row: nothing yet, after system, after user, after assistant. A value is the cost in
    nine digits and the edits, so that the least text is the least value."""
    add = lambda v, cost, letter: f"(printf('%09d', substr({v}, 1, 9)::INTEGER + {cost}) || substr({v}, 10) || '{letter}')"
    best = "least(d.q, d.s, d.a)"
    return r"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') AS conv, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
crc AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END)), 4294967295::BIGINT) % 20 AS h FROM k),
damaged AS (SELECT conv, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM crc, (SELECT unnest([1, 2]) AS n) WHERE n <= CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) - 1 AS place, substr(role, 1, 1) AS r, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM damaged),
rows_ AS MATERIALIZED (SELECT *, CASE WHEN t = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY place) > 1 THEN 2 WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS f,
  CASE WHEN lag(r) OVER (PARTITION BY conv ORDER BY place) || r NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END AS odd FROM placed),
dp AS (SELECT conv, 0 AS place, '000000000' AS q, NULL::VARCHAR AS s, '000000005I' AS u, '000000010II' AS a FROM (SELECT DISTINCT conv FROM rows_)
 UNION ALL SELECT conv, place, q, s, u2, least(a1, """ + add("u2", 5, "I") + r""") FROM (SELECT *, least(u1, """ + add("least(q, s, a1)", 5, "I") + r""") AS u2 FROM (
  SELECT d.conv, d.place + 1 AS place, """ + add("d.q", 2, "D") + " AS q, least(" + add("d.s", 2, "D") + ", CASE WHEN f IN (0, 3) AND r = 's' THEN " + add("d.q", "CASE f WHEN 3 THEN 5 ELSE 0 END", "K") + r""" END) AS s,
  least(""" + add("d.u", 2, "D") + ", CASE WHEN f IN (0, 3) THEN CASE r WHEN 'u' THEN " + add(best, "CASE f WHEN 3 THEN 5 ELSE 0 END", "K") + " ELSE " + add(best, "CASE f WHEN 3 THEN 6 ELSE 1 END", "R") + r""" END END) AS u1,
  least(""" + add("d.a", 2, "D") + ", CASE WHEN f IN (0, 3) THEN CASE r WHEN 'a' THEN " + add("d.u", "CASE f WHEN 3 THEN 5 ELSE 0 END", "K") + " ELSE " + add("d.u", "CASE f WHEN 3 THEN 6 ELSE 1 END", "R") + r""" END END) AS a1
  FROM dp d JOIN rows_ x ON x.conv = d.conv AND x.place = d.place))),
best AS (SELECT conv, substr(v, 1, 9)::BIGINT AS cost, substr(v, 10) AS audit FROM (SELECT conv, least(q, a) AS v FROM dp WHERE (conv, place) IN (SELECT (conv, count(*)) FROM rows_ GROUP BY conv))),
letters AS (SELECT conv, l, i, count(*) FILTER (WHERE l <> 'I') OVER (PARTITION BY conv ORDER BY i) - 1 AS place FROM (SELECT conv, unnest(string_split(audit, '')) AS l, generate_subscripts(string_split(audit, ''), 1) AS i FROM best WHERE audit <> '')),
steps AS (SELECT e.conv, e.l, e.i, x.role, x.r, x.text, row_number() OVER (PARTITION BY e.conv ORDER BY e.i) - 1 AS p FROM letters e LEFT JOIN rows_ x ON x.conv = e.conv AND x.place = e.place AND e.l <> 'I' WHERE e.l <> 'D'),
headed AS (SELECT conv, max(CASE WHEN p = 0 AND l = 'K' AND r = 's' THEN 1 ELSE 0 END) AS head FROM steps GROUP BY conv),
said AS (SELECT conv, sha256(string_agg(CASE l WHEN 'K' THEN role ELSE CASE (p - head) % 2 WHEN 0 THEN 'user' ELSE 'assistant' END END || ':' || CASE l WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS h FROM steps JOIN headed USING (conv) GROUP BY conv),
sums AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE f = 1) AS blank, count(*) FILTER (WHERE f = 2) AS duplicate, count(*) FILTER (WHERE f = 3) AS truncated, sum(odd)::BIGINT AS illegal FROM rows_ GROUP BY conv)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM k) a LEFT JOIN sums USING (conv) LEFT JOIN best USING (conv) LEFT JOIN said USING (conv)"""


ORACLE_SQL: dict[str, str] = {
    "op12_delta_lloyd": lloyd_sql(),
    "op13_role_repair": repair_sql(),
    "op2_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.c AS component_id, d.doc_id = c.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) c USING (doc_id)
""",
    "op3_decontaminate": r"""
WITH w AS (
  SELECT 0 AS kind, doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL SELECT 1, item_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') FROM benchmark),
s AS (
  SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM w),
n AS (SELECT id, count(*) AS n FROM s WHERE kind = 1 GROUP BY id)
SELECT a.id AS doc_id, b.id AS item_id, n.n AS n_item, count(*) AS n_shared, count(*) / n.n AS containment
FROM s a JOIN s b ON a.g = b.g AND a.kind = 0 AND b.kind = 1 JOIN n ON n.id = b.id GROUP BY a.id, b.id, n.n HAVING 100 * count(*) >= 75 * n.n
""",
    "op4_mix_sources": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT source, source_size, CASE place % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS most FROM s),
o AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM w) - coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
l AS (SELECT level FROM o WHERE level * w <= most ORDER BY most / w LIMIT 1),
t AS (SELECT w.source, source_size, round(least(most, (SELECT level FROM l) * w), 6) AS target FROM w),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 2.0) ELSE 0 END AS rate,
  ('0x' || substr(md5('mix-1:' || d.doc_id), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
""",
}
