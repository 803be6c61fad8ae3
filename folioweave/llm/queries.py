"""The queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.llm import ann, decontam, hmm, langid, lexical, mixing, pii, prefixtrie, repeats, simhash, tokencounts, urls, warc
from folioweave.llm.shared import SharedTables


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = SharedTables(spark)
    docs = read(spark, sf_dir, "documents")
    slim = tables.write(mixing.measure(docs).select("doc_id", "source", "size", "place"), "sizes")
    mixed = mixing.apply_cuts(slim, mixing.cuts(slim, tables))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_documents(read(spark, sf_dir, "documents"))


def op3_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(read(spark, sf_dir, "documents"))
    return found.withColumn("base_sha256", F.sha2("base", 256)).drop("base")


#: The URL rules of op4 (verdict, host, path).
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op4_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, URL_RULES, urls.train(urls.labelled_by_rules(pages, URL_RULES)))


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op6_winnowing_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n_hit = F.size("hits").cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontam.is_contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


def op7_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op9_hierarchical_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op10_collision_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.section_tokens(read(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read(spark, sf_dir, "documents"), texts=False)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(prefixtrie.share_openings(prefixtrie.paths(read(spark, sf_dir, "conversations"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_hmm_scores": op2_hmm_scores,
    "op3_skip_chain_pii": op3_skip_chain_pii,
    "op4_url_verdicts": op4_url_verdicts,
    "op5_warc_round_trip": op5_warc_round_trip,
    "op6_winnowing_contamination": op6_winnowing_contamination,
    "op7_simhash_components": op7_simhash_components,
    "op8_section_tokens": op8_section_tokens,
    "op9_hierarchical_language": op9_hierarchical_language,
    "op10_collision_neighbours": op10_collision_neighbours,
    "op11_ranked_search": op11_ranked_search,
    "op12_repeated_passages": op12_repeated_passages,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES: dict[str, str] = {
    "op1_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15) AS place
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
t AS (
  SELECT *, 3 * source_size AS full_, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w FROM s),
u AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(full_) OVER (ORDER BY full_ / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS num,
         sum(w) OVER (ORDER BY full_ / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS den,
         row_number() OVER (ORDER BY full_ / w, source NULLS LAST) AS k
  FROM t),
f AS (SELECT k AS k0, num AS num0, den AS den0 FROM u WHERE w * num <= full_ * den ORDER BY k LIMIT 1),
g AS (
  SELECT source, source_size, CASE WHEN k < k0 THEN full_ ELSE (w * num0) // den0 END::BIGINT AS budget,
         CASE WHEN k < k0 THEN full_::DOUBLE ELSE (w * num0)::DOUBLE / den0::DOUBLE END AS target
  FROM u, f),
r AS (
  SELECT d.*, g.source_size, g.target, budget // greatest(g.source_size, 1) AS copies, budget % greatest(g.source_size, 1) AS within,
         sum(size) OVER (PARTITION BY d.source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(size) OVER (PARTITION BY d.source, place) AS same
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (size * copies + CASE WHEN upto <= within THEN size WHEN upto - same < within THEN (size * (within - (upto - same))) // same ELSE 0 END)::BIGINT AS taken
FROM r""",
    "op6_winnowing_contamination": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(ws), 13) AS n, array_to_string(ws[i : i + least(len(ws), 13) - 1], ' ') AS w
  FROM (SELECT item, ws, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS i FROM b WHERE len(ws) > 0)),
dw AS (
  SELECT rid, n, i, array_to_string(ws[i : i + n - 1], ' ') AS w
  FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)),
m AS (SELECT rid, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.w = bw.w),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM m) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT rid, item FROM m) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)""",
    "op5_warc_round_trip": """
WITH p AS (
  SELECT page_id, row_number() OVER () AS rid, octet_length(encode(coalesce(html, ''))) AS payload_bytes, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex
  FROM pages),
q AS (SELECT *, row_number() OVER (PARTITION BY payload ORDER BY page_id DESC NULLS LAST, rid DESC) AS k, first(page_id) OVER (PARTITION BY payload ORDER BY page_id DESC NULLS LAST, rid DESC) AS response FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 10 * (i // 8) + 1, 10))::BIGINT >> (5 * (7 - i % 8))) & 31)::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN response END AS refers_to
FROM q""",
    "op11_ranked_search": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
n AS (SELECT count(*) FILTER (WHERE len(ts) > 0)::BIGINT AS N, coalesce(sum(len(ts)), 0)::BIGINT AS L FROM d),
q AS (
  SELECT iid, item_id, t, count(*)::BIGINT AS c
  FROM (SELECT row_number() OVER () AS iid, item_id,
               unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark)
  GROUP BY ALL),
p AS (
  SELECT rid, doc_id, t, count(*)::BIGINT AS tf, (75 + (25 * any_value(len(ts))::BIGINT * any_value(N)) // any_value(L))::BIGINT AS m
  FROM (SELECT rid, doc_id, ts, N, L, unnest(ts) AS t FROM d, n) WHERE t IN (SELECT t FROM q) GROUP BY rid, doc_id, t),
w AS (SELECT t, floor(1000 * ln((2 * any_value(N) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, n GROUP BY t),
s AS (
  SELECT iid, item_id, rid, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN p USING (t) JOIN w USING (t) GROUP BY ALL)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM s WHERE score > 0) WHERE rank <= 20""",
    "op12_repeated_passages": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT rid, doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS h FROM (SELECT *, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)),
f AS (SELECT h, min(doc_id) AS first FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT rid, unnest(range(i, i + 50)) AS p FROM w JOIN f USING (h) WHERE doc_id > first),
r AS (SELECT rid, count(*) AS n, list(p) AS gone FROM g GROUP BY rid),
x AS (SELECT d.*, n, list_transform(range(1, len(ws) + 1), lambda p: NOT list_contains(gone, p)) AS stays FROM d JOIN r USING (rid))
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(x.n, 0)::BIGINT AS n_removed,
       sha256(CASE WHEN x.rid IS NULL THEN array_to_string(d.ws, ' ') ELSE array_to_string(list_where(x.ws, x.stays), ' ') END) AS kept_sha256
FROM d LEFT JOIN x USING (rid)""",
    "op13_prefix_trie": r"""
WITH t AS (
  SELECT conv_id, turn, dense_rank() OVER (ORDER BY coalesce(role, ''), coalesce(text, '')) AS x,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'x': x, 'w': w} ORDER BY turn NULLS FIRST, x) AS p FROM t GROUP BY conv_id),
bits AS (
  SELECT b, list_reduce(list_prepend(b::BIGINT, range(8)), lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::BIGINT) ELSE r >> 1 END) AS v
  FROM (SELECT unnest(range(256)) AS b)),
tab AS (SELECT list(v ORDER BY b) AS v FROM bits),
h AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i::INT, 1))::BIGINT)),
           lambda c, b: xor(v[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT) % 4 AS h
  FROM own, tab),
full_ AS (
  SELECT o.conv_id, list_concat(coalesce(s.p[1:h], []), o.p[h + 1:]) AS p
  FROM own o JOIN h USING (conv_id) LEFT JOIN own s ON s.conv_id = o.conv_id - o.conv_id % 20),
pre AS (SELECT conv_id, len(p) AS n, d, p[1:d] AS q FROM (SELECT *, unnest(range(0, len(p) + 1)) AS d FROM full_)),
node AS (
  SELECT q, d, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CASE WHEN n = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id) AS ends
  FROM pre GROUP BY q, d),
kid AS (SELECT q[1:d - 1] AS q, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
both_ AS (SELECT node.*, coalesce(kid.n, 0) AS kids FROM node LEFT JOIN kid ON kid.d = node.d AND kid.q = node.q),
up AS (SELECT q[1:k] AS q, k AS d, kids, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * q[d].w END AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM both_)),
sub AS (SELECT q, d, count(*) FILTER (WHERE kids = 0) AS leaves, sum(saved) AS saved FROM up GROUP BY q, d)
SELECT b.conv_id, b.d::BIGINT AS depth, par.conv_id AS parent_conv_id, b.n_convs, b.kids::BIGINT AS n_children, leaves::BIGINT AS n_leaves, sub.saved::BIGINT AS saved_tokens,
       sha256(coalesce(b.ends, '')) AS ends_sha256
FROM both_ b JOIN sub ON sub.d = b.d AND sub.q = b.q LEFT JOIN node par ON par.d = b.d - 1 AND par.q = b.q[1:b.d - 1]""",
}
