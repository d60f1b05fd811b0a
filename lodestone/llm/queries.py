"""The registered queries of this subpackage: thin readings of the operators' results."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .embedding_dedup import embedding_links
from .filter_audit import filter_audit
from .license_scan import license_scan
from .line_dedup import line_dedup
from .mixing import mix_sources
from .packing import best_fit_packing
from .secret_scan import listed, secret_scan
from .simhash import simhash_components
from .substring_dedup import substring_dedup
from .topk_search import topk_search
from .toxicity import toxicity
from .url_filter import url_filter
from .whitening import whiten

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def vocabulary() -> str:
    """The installed byte-level vocabulary in the json form of `tokenizers`."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document kept after windows of 20 words that start earlier are removed; odd rows as in `substring_dedup`."""
    out = substring_dedup(table(spark, sf_dir, "documents"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at cosine 0.93 and components of all rows of embeddings; odd rows as in `embedding_links`."""
    return embedding_links(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as pieces of at most 2048 ids, packed; odd rows as in `best_fit_packing`."""
    return best_fit_packing(table(spark, sf_dir, "documents"), vocabulary(), size=2048)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url; odd rows as in `url_filter`."""
    return url_filter(table(spark, sf_dir, "pages"), RULES).drop("component")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learnt from labels that are not held out; odd rows as in `toxicity`."""
    out = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), threshold=0.3)
    return out.select("doc_id", "held_out", "score", "predicted")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without lines that start earlier, equal or within two edits; odd rows as in `line_dedup`."""
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines_gone")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document; odd rows as in `mix_sources`."""
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and spans of every document; odd rows as in `license_scan`."""
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best rows of embeddings for each vec_id divisible by 100; odd rows as in `topk_search`."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk_search(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of four-word shingles and component within four bits of every document; odd rows as in `simhash_components`."""
    out = simhash_components(table(spark, sf_dir, "documents"), width=4, differ=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over every document in all orders, by part; odd rows as in `filter_audit`."""
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable row of embeddings on the first four whitened components; odd rows as in `whiten`."""
    return whiten(table(spark, sf_dir, "embeddings"), components=4, scale=256)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, base spans and linked ones; odd rows as in `secret_scan`."""
    out = secret_scan(table(spark, sf_dir, "documents"), reach=500)
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_embedding_dedup, op3_best_fit_packing, op4_url_filter, op5_toxicity, op6_line_dedup, op7_source_mixing, op8_license_scan, op9_topk_search, op10_simhash_dedup, op11_filter_audit, op12_embedding_whitening, op13_secret_scan)}

def either(words: str) -> str:
    """A pattern of small letters that takes ASCII capitals as well; (?i) would also fold letters outside ASCII."""
    return re.sub("[a-z]", lambda m: f"[{m.group()}{m.group().upper()}]", words)


ASSIGNED = r"""["'']?\x20*[:=]\x20*["'']?"""
SECRET_PATTERNS = {
    "assign": either("(password|passwd|secret|token|api_?key)") + ASSIGNED + "([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
    "endpoint": r"\b(?:" + either("https?|ftp|sftp|ssh|s") + "3|" + either("jdbc") + ":[A-Za-z]+|" + either("postgres(?:ql)?|mysql|mongodb|redis|amqps?") + r""")://[^\x20\x09-\x0D"''<>]+|\b(?:"""
    + either("host|hostname|endpoint|server|base_?url|bucket") + ")" + ASSIGNED + "[A-Za-z0-9][A-Za-z0-9.:/_-]{2,}",
    "identifier": r"\b(?:" + either("access_?key(?:_?id)?|client_?id|account(?:_?id)?|user_?name|user|login|key_?id") + ")" + ASSIGNED + "[A-Za-z0-9@._-]{3,}",
    "value": "[A-Za-z0-9+/_=-]{20,}",
    "blank": r"\n[\x20\t\r]*\n",
}

ORACLES = {
    "op1_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, unnest(range(1, len(words) - 18)) AS i, words FROM w WHERE len(words) >= 20
), win AS (
  SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS g FROM s
), ranked AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM win
), gone AS (
  SELECT doc_id, list(DISTINCT i + k ORDER BY i + k) AS gone_at FROM (SELECT doc_id, i FROM ranked WHERE r > 1), range(0, 20) AS t(k) GROUP BY doc_id
)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone_at), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone_at IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(gone_at, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id""",
    "op2_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_dot_product(x, x) > 0
), e AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x)) >= 0.93
), reach AS (
  SELECT vec_id AS s, vec_id AS t FROM v UNION SELECT reach.s, e.v FROM reach JOIN e ON reach.t = e.u
), c AS (SELECT s, min(t) AS component_id FROM reach GROUP BY s),
n AS (SELECT u, count(*) AS n FROM e GROUP BY u)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.s = v.vec_id LEFT JOIN n ON n.u = v.vec_id""",
    "op4_url_filter": r"""
WITH RECURSIVE rules(own, rule, host, prefix) AS (
  VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'),
         ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')
), shown AS (
  SELECT page_id, url, regexp_extract(url, '^([^:/?#]*)://', 1) AS scheme, regexp_extract(url, '^((?s:.*?)://[^/?#]*)', 1) AS top,
    regexp_extract(url, '^((?s:.*?)://[^?#]*)', 1) AS whole_path, regexp_extract(url, '^((?s:.*?)://[^/?#]*(?:[^?#]*/)?)', 1) AS folder,
    regexp_extract_all(regexp_replace(html, '(?s)<!--.*?(?:-->|\z)', '', 'g'), '(?is)(<(?:link|meta)\b[^>]*>)') AS tags FROM pages
), tags AS (
  SELECT * EXCLUDE (tags), unnest(list_filter(tags, lambda t: regexp_matches(t, '(?is)^<link\b.*?[\s"''/]rel\s*=\s*(?:"[^"]*\bcanonical\b|''[^'']*\bcanonical\b|canonical\b)')
    OR regexp_matches(t, '(?is)^<meta\b.*?[\s"''/]http-equiv\s*=\s*["'']?\s*refresh\b'))) AS tag FROM shown WHERE top <> ''
), named AS (
  SELECT *, CASE WHEN regexp_matches(tag, '(?i)^<link\b') THEN regexp_extract(tag, '(?is)[\s"''/]href\s*=\s*["'']?\s*([^"''\s>]+)', 1)
    ELSE regexp_extract(tag, '(?is)\burl\s*=\s*["'']?\s*([^"''\s>]+)', 1) END AS raw FROM tags
), decoded AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '&(?:quot|#34|#x22);', '"', 'gi'), '&(?:apos|#39|#x27);', '''', 'gi'),
    '&(?:lt|#60|#x3c);', '<', 'gi'), '&(?:gt|#62|#x3e);', '>', 'gi'), '&(?:#47|#x2f);', '/', 'gi'), '&(?:amp|#38|#x26);', '&', 'gi') AS t FROM named
), joined AS (
  SELECT page_id, url, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN t LIKE '//%' THEN scheme || ':' || t WHEN t LIKE '/%' THEN top || t
    WHEN t LIKE '?%' THEN whole_path || t WHEN folder LIKE '%/' THEN folder || t ELSE folder || '/' || t END AS u FROM decoded WHERE t <> '' AND t NOT LIKE '#%'
), split_up AS (
  SELECT *, regexp_extract(u, '^((?s:.*?)://[^/?#]*)', 1) AS utop, regexp_extract(u, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS upath, regexp_extract(u, '^(?s:.*?)://[^/?#]*[^?#]*((?s:.*))', 1) AS urest FROM joined
), links AS (
  SELECT page_id, url, CASE WHEN NOT regexp_matches(upath, '/\.\.?(?:/|\z)') THEN u ELSE utop || '/' || array_to_string(list_reduce(
      list_transform(string_split(upath, '/')[2:], lambda x: [x]),
      lambda done, part: CASE WHEN part[1] = '..' THEN done[1:len(done) - 1] WHEN part[1] = '.' THEN done ELSE list_concat(done, part) END, []::VARCHAR[])
    || CASE WHEN string_split(upath, '/')[-1] IN ('.', '..') THEN [''] ELSE []::VARCHAR[] END, '/') || urest END AS url2 FROM split_up
), all_urls AS (SELECT url FROM pages UNION SELECT url2 FROM links),
parsed AS (
  SELECT url, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path,
    regexp_extract(url, '^(?s:.*?)://[^/?#]*([^#]*)', 1) AS rest FROM all_urls
), noded AS (
  SELECT url, host, path, CASE WHEN host <> '' THEN host || regexp_replace(regexp_replace(
    regexp_replace(regexp_replace(rest, '([?&])(?:(?:utm_\w+|gclid|fbclid|mc_cid|mc_eid)=[^&]*&?)+', '\1', 'g'), '[?&]+$', ''), '/+(\?|$)', '\1'), '$', '') END AS node FROM parsed
), fits AS (
  SELECT host, path, r.rule, r.own, row_number() OVER (PARTITION BY n.host, n.path ORDER BY length(r.rule) DESC, r.own DESC, r.rule DESC) AS k
  FROM (SELECT DISTINCT host, path FROM noded WHERE host <> '') n JOIN rules r(own, rule, rhost, prefix)
    ON (n.host = r.rhost OR n.host LIKE '%.' || r.rhost) AND starts_with(n.path, r.prefix)
), ruled AS (SELECT n.*, f.rule, f.own FROM noded n LEFT JOIN (SELECT * FROM fits WHERE k = 1) f ON n.host = f.host AND n.path = f.path),
e AS (SELECT a.node AS u, b.node AS v FROM links l JOIN noded a ON a.url = l.url JOIN noded b ON b.url = l.url2 WHERE a.node IS NOT NULL AND b.node IS NOT NULL),
both_ways AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
bad AS (SELECT DISTINCT node FROM ruled WHERE own = 'block' AND node IS NOT NULL UNION SELECT b.v FROM bad JOIN both_ways b ON b.u = bad.node)
SELECT p.page_id, coalesce(r.host, '') AS host, coalesce(r.path, '') AS path, r.rule, coalesce(r.own, CASE WHEN r.node IN (SELECT node FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM pages p LEFT JOIN ruled r ON r.url = p.url""",
    "op9_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda c: floor(1024 * c)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.x, v.x)::BIGINT AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, k::INTEGER AS rank, vec_id, score FROM r WHERE k <= 10""",
    "op11_filter_audit": r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), firsts AS (SELECT t, min(doc_id) AS least FROM w GROUP BY t),
d AS (
  SELECT w.doc_id, part, CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(w.t, '[^A-Z]+', '', 'g')) > 2 * length(w.t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(w.t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN w.doc_id > least THEN 16 ELSE 0 END AS mask FROM w JOIN firsts ON w.t = firsts.t
), l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
cells AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM d LEFT JOIN l ON d.doc_id = l.doc_id GROUP BY part, mask),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order FROM f a, f b, f c, f d, f e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, step::INTEGER AS step, (SELECT bit FROM f WHERE letter = filter_order[step]) AS bit,
    (SELECT coalesce(sum(bit), 0)::INT FROM f WHERE contains(filter_order[1:step - 1], letter)) AS before FROM orders, range(1, 6) AS r(step)
)
SELECT part, filter_order, step, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
  sum(CASE WHEN mask & bit <> 0 THEN n * 120 // bit_count(mask) ELSE 0 END)::BIGINT AS shapley
FROM cells, steps GROUP BY part, filter_order, step""",
    "op13_secret_scan": """
WITH p AS (SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS t FROM documents),
pat(kind, rank, pattern) AS (VALUES """ + ", ".join(f"('{kind}', {rank}, '{pattern}')" for rank, (kind, pattern) in enumerate(SECRET_PATTERNS.items())) + r"""),
hit AS (SELECT k, kind, rank, regexp_extract_all(t, pattern) AS ms, string_split_regex(t, pattern) AS gaps FROM p, pat),
each AS (SELECT k, kind, rank, unnest(gaps[1:len(ms)]) AS gap, unnest(ms) AS m, unnest(range(len(ms))) AS i FROM hit WHERE len(ms) > 0),
ended AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY k, kind ORDER BY i) AS e FROM each),
span AS (
  SELECT k, kind, rank, m, (e - length(m))::BIGINT AS s, e::BIGINT AS e FROM ended WHERE CASE kind
    WHEN 'assign' THEN length(regexp_extract(m, '""" + SECRET_PATTERNS["assign"] + r"""', 2)) >= 6 WHEN 'access' THEN length(m) >= 20 WHEN 'hex' THEN length(m) >= 24
    WHEN 'value' THEN regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9]') ELSE true END
), base AS (SELECT * FROM span WHERE rank < 3),
free AS (SELECT * FROM span a WHERE rank BETWEEN 3 AND 5 AND NOT EXISTS (FROM base b WHERE b.k = a.k AND b.s < a.e AND a.s < b.e)),
f3 AS (SELECT * FROM free WHERE rank = 3),
f4 AS (SELECT * FROM free a WHERE rank = 4 AND NOT EXISTS (FROM f3 b WHERE b.k = a.k AND b.s < a.e AND a.s < b.e)),
f5 AS (SELECT * FROM free a WHERE rank = 5 AND NOT EXISTS (FROM (FROM f3 UNION ALL FROM f4) b WHERE b.k = a.k AND b.s < a.e AND a.s < b.e)),
parts AS (FROM base UNION ALL FROM f3 UNION ALL FROM f4 UNION ALL FROM f5),
offs AS (SELECT a.*, coalesce((SELECT max(b.e) FROM span b WHERE b.k = a.k AND b.kind = 'blank' AND b.e <= a.s), 0) AS para FROM parts a),
placed AS (SELECT *, (s - para) // 500 - t.j AS tile FROM offs, (VALUES (0), (1)) t(j) WHERE (s - para) // 500 >= t.j),
held AS (
  SELECT k, para, tile, bool_or(kind IN ('access', 'identifier')) AS has_id, bool_or(kind IN ('assign', 'hex', 'value')) AS has_secret FROM placed GROUP BY k, para, tile
), shown AS (
  SELECT k, kind, rank, s, e FROM base UNION
  SELECT k, kind, rank, s, e FROM f3 WHERE regexp_matches(m, '://[^/?#@:]*:[^/?#@]+@') UNION
  SELECT a.k, kind, rank, s, e FROM placed a JOIN held h ON a.k = h.k AND a.para = h.para AND a.tile = h.tile
  WHERE CASE kind WHEN 'endpoint' THEN has_id AND has_secret WHEN 'identifier' THEN has_secret WHEN 'value' THEN has_id ELSE false END
), texts AS (SELECT k, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans, coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3), '') AS base FROM shown GROUP BY k),
n AS (SELECT k, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex FROM base GROUP BY k)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM p LEFT JOIN texts ON p.k = texts.k LEFT JOIN n ON p.k = n.k""",
}
