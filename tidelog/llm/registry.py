"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm.cluster import table


def op1_mih_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tidelog.llm import mih

    return mih.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm import simhash

    return simhash.searched(table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm import html

    return html.main_text(table(spark, sf_dir, "pages"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidelog.llm import packing

    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm import licenses

    return licenses.scan(table(spark, sf_dir, "documents"))


def _op5_sql() -> str:
    """Containment of every template in every window, without signatures."""
    from tidelog.llm import licenses

    rows = []
    for name, text in sorted(licenses.NOTICES.items()):
        w = licenses.words_of(text)
        items = sorted({" ".join(w[i : i + licenses.WIDTH]) for i in range(max(1, len(w) - licenses.WIDTH + 1))})
        rows += [f"('{name}', '{x}', {len(items)})" for x in items]
    return f"""
WITH t(license, item, m) AS (VALUES {", ".join(rows)}),
w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(0, greatest(1, len(w) - 2))) AS i, w FROM w WHERE len(w) > 0),
g AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 3], ' ') AS item FROM s),
h AS (SELECT g.doc_id, t.license, t.m, g.item, g.i FROM g JOIN t USING (item)),
b AS (SELECT doc_id, license, m, item, i // m * m AS word FROM h UNION ALL SELECT doc_id, license, m, item, (i // m - 1) * m FROM h WHERE i >= m),
c AS (SELECT doc_id, license, word, count(DISTINCT item) / m::DOUBLE AS containment FROM b GROUP BY doc_id, license, m, word)
SELECT doc_id, license, max(containment) AS containment, count(*) AS windows, arg_max(word, (containment, -word)) AS word
FROM c WHERE containment >= 0.8 GROUP BY doc_id, license
"""


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tidelog.llm import langid

    docs = table(spark, sf_dir, "documents")
    model = langid.fit(langid.sample(docs))
    rows = docs.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "text")
    return langid.classify(rows, model).select("doc_id", "held_out", "lang_pred", "score", "accepted")


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm import hmm

    return hmm.score(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm import partenum

    return partenum.components(table(spark, sf_dir, "documents"), width=3, num=90, den=100).drop("cls", "text_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm import mixing

    return mixing.mix(table(spark, sf_dir, "documents")).drop("times")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm import warc

    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM q
"""


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.root) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if callable(v) and (k == "pipeline" or re.match(r"op\d", k))}


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 9))::BIGINT AS place,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, 1.0::DOUBLE + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w, 3.0::DOUBLE * source_size AS cap, sum(source_size) OVER () AS total FROM s),
l AS (SELECT *, (total::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS here FROM r),
t AS (SELECT source, source_size, least(cap, w * max(here) OVER ()) AS target FROM l),
u AS (SELECT *, CAST(floor(target / greatest(source_size, 1) + 1e-9) AS BIGINT) AS whole FROM t),
g AS (SELECT d.source, place, sum(size) AS tokens FROM d GROUP BY ALL),
c AS (SELECT g.source, place, sum(tokens) OVER (PARTITION BY g.source ORDER BY place) AS upto, tokens FROM g),
b AS (SELECT c.source, place, CASE WHEN upto <= greatest(0, target - whole * source_size) THEN 1
         WHEN upto - tokens <= greatest(0, target - whole * source_size) AND upto - greatest(0, target - whole * source_size) < greatest(0, target - whole * source_size) - (upto - tokens) THEN 1
         ELSE 0 END AS once
      FROM c JOIN u ON c.source IS NOT DISTINCT FROM u.source)
SELECT d.doc_id, d.size, u.source_size, u.target, CAST(least(3, u.whole + b.once) * d.size AS BIGINT) AS taken
FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source JOIN b ON d.source IS NOT DISTINCT FROM b.source AND d.place = b.place
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_licenses": _op5_sql(), "op8_jaccard_join": OP8_SQL, "op9_mixing": OP9_SQL, "op10_warc": OP10_SQL}
