"""The queries of this subpackage and their SQL. Each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import url_filter

    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_filter(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_join

    return ngram_join(table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import derivatives, responses

    made = derivatives(responses(table(spark, sf_dir, "pages")), keep=["page_id"])
    return made.select("page_id", "response_id", "metadata_id", "conversion_id", "target_uri", "date", "payload_digest", "block_digest", F.sha2("metadata", 256).alias("metadata_sha256"), F.sha2("conversion", 256).alias("conversion_sha256"), F.length("text").cast("long").alias("n_chars"), "error")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_spans

    found = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), "byte_bpe_50k.json").withColumn("over_limit", F.col("n_tokens") > 1024)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit_quality, held_out, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.length("text").cast("long").alias("n_chars_kept"), F.sha2("text", 256).alias("text_sha256"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import damaged, repair

    rows = table(spark, sf_dir, "conversations")
    return repair(damaged(rows), rows.select("conv_id"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import divergence

    return divergence(table(spark, sf_dir, "documents"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_ngram_join": op2_ngram_join,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_warc_derivatives": op4_warc_derivatives,
    "op5_decontaminate": op5_decontaminate,
    "op6_html_extract": op6_html_extract,
    "op7_token_counts": op7_token_counts,
    "op8_quality_rules": op8_quality_rules,
    "op9_line_dedup": op9_line_dedup,
    "op10_mix_sources": op10_mix_sources,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_source_divergence": op12_source_divergence,
    "op13_exact_dedup": op13_exact_dedup,
}

# the SQL as it was given: it blocks net/de/, which the contract and URL_RULES allow
_RULES_SQL = "('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')"

SQL: dict[str, str] = {
    "op1_url_filter": rf"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
rules(rhost, rpath, action) AS (VALUES {_RULES_SQL}),
won AS (
  SELECT DISTINCT p.host, p.path,
    first_value(rhost || rpath) OVER (PARTITION BY p.host, p.path ORDER BY length(rhost || rpath) DESC) AS rule,
    first_value(action) OVER (PARTITION BY p.host, p.path ORDER BY length(rhost || rpath) DESC) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts) p
  JOIN rules ON (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath))
SELECT parts.page_id, parts.host, parts.path, won.rule, coalesce(won.verdict, 'allow') AS verdict
FROM parts LEFT JOIN won ON parts.host = won.host AND parts.path = won.path
""",
    "op5_decontaminate": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
sized AS (SELECT item_id, ws, least(10, len(ws)) AS n FROM b WHERE len(ws) > 0),
win AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[k:k + n - 1], ' ') AS k
  FROM (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM sized)),
sizes AS (SELECT DISTINCT n FROM win),
spots AS (
  SELECT doc_id, n, k, array_to_string(ws[k:k + n - 1], ' ') AS g
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM w, sizes WHERE len(ws) >= n)),
hit AS (SELECT spots.doc_id, spots.n, spots.k, win.item_id FROM spots JOIN win ON spots.n = win.n AND spots.g = win.k),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
own AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS s
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
SELECT w.doc_id, coalesce(len(ws), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN pos ON w.doc_id = pos.doc_id LEFT JOIN own ON w.doc_id = own.doc_id
""",
    "op9_line_dedup": r"""
WITH cut AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
lines AS (
  SELECT doc_id, p, trim(regexp_replace(lower(ls[p]), '[ \x09-\x0D]+', ' ', 'g'), ' ') AS line, ls[p] AS orig
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS p FROM cut)),
worded AS (
  SELECT doc_id, p, line, orig, CASE WHEN line = '' THEN 0 ELSE len(string_split(line, ' ')) END AS n,
    row_number() OVER (ORDER BY doc_id, p) AS pos FROM lines),
firsts AS MATERIALIZED (SELECT line, min(pos) AS pos FROM worded WHERE n >= 1 GROUP BY line),
longs AS MATERIALIZED (SELECT * FROM (SELECT f.line, f.pos, string_split(f.line, ' ') AS ws FROM firsts f) WHERE len(ws) >= 5),
less AS MATERIALIZED (
  SELECT pos, i, array_to_string(list_concat(ws[1:i - 1], ws[i + 1:]), ' ') AS v
  FROM (SELECT pos, ws, unnest(range(1, len(ws) + 1)) AS i FROM longs)),
at_same AS (SELECT pos, min(pos) OVER (PARTITION BY v, i) AS e FROM less),
part_of AS (
  SELECT l.pos, w.pos AS e FROM less l JOIN longs w ON l.v = w.line
  UNION ALL SELECT w.pos, l.pos FROM less l JOIN longs w ON l.v = w.line),
ends AS (
  SELECT pos, ws, unnest(list_distinct([length(bin(len(ws) // 3)) - 1, length(bin((len(ws) - len(ws) // 10) // 3)) - 1])) AS z FROM longs WHERE len(ws) >= 20),
pieces AS (
  SELECT pos, ws, z, 1 AS side, array_to_string(ws[1:1 << z], ' ') AS piece FROM ends
  UNION ALL SELECT pos, ws, z, 2, array_to_string(ws[len(ws) - (1 << z) + 1:], ' ') FROM ends),
alike AS (SELECT DISTINCT pos, ws, e FROM (SELECT pos, ws, min(pos) OVER (PARTITION BY z, side, piece) AS e FROM pieces) WHERE e < pos),
pairs AS (
  SELECT a.pos, a.e, a.ws AS x, b.ws AS y, least(len(a.ws), len(b.ws)) // 10 AS k FROM alike a JOIN longs b ON b.pos = a.e),
-- the edit distance in words, row by row
far AS (
  SELECT pos, e FROM pairs WHERE abs(len(x) - len(y)) <= k AND list_reduce(range(1, len(x) + 1), lambda r, i:
    list_reduce(range(1, len(y) + 1), lambda q, j: list_append(q, least(r[j + 1] + 1, q[-1] + 1, r[j] + CASE WHEN x[i] = y[j] THEN 0 ELSE 1 END)), [r[1] + 1]), range(0, len(y) + 1))[-1] <= k),
near AS (SELECT DISTINCT pos FROM (SELECT * FROM at_same UNION ALL SELECT * FROM part_of UNION ALL SELECT * FROM far) WHERE e < pos),
kept AS (
  SELECT w.doc_id, w.p, w.orig, w.n >= 1 AND (w.pos <> f.pos OR x.pos IS NOT NULL) AS gone
  FROM worded w LEFT JOIN firsts f ON w.line = f.line AND w.n >= 1 LEFT JOIN near x ON x.pos = f.pos),
again AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(orig, chr(10) ORDER BY p) FILTER (NOT coalesce(gone, false)), '') AS text
  FROM kept GROUP BY doc_id)
SELECT c.doc_id, len(c.ls) AS n_lines, a.n_removed, length(a.text) AS n_chars_kept, sha256(a.text) AS text_sha256
FROM cut c JOIN again a ON c.doc_id = a.doc_id
""",
    "op2_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
grams AS (
  SELECT DISTINCT doc_id, hash(array_to_string(ws[k:k + 4], ' ')) AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS k FROM w WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
pairs AS (
  SELECT a, b, c / (x.n + y.n - c) AS j FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE c / (x.n + y.n - c) >= 0.8),
links AS (SELECT a, b, j FROM pairs UNION ALL SELECT b, a, j FROM pairs),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least_id AS (SELECT a, min(b) AS m FROM reach GROUP BY 1),
direct AS (SELECT a, count(*) AS n, min(b) FILTER (j = 1) AS c FROM links GROUP BY 1)
SELECT doc_id, coalesce(least(c, doc_id), doc_id) AS copy_of, coalesce(least(m, doc_id), doc_id) AS class_id, coalesce(n, 0) AS n_links,
  coalesce(least(m, doc_id), doc_id) = doc_id AS kept
FROM w LEFT JOIN least_id ON least_id.a = doc_id LEFT JOIN direct ON direct.a = doc_id
""",
    "op3_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.9),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least_id AS (SELECT a, min(b) AS m FROM reach GROUP BY 1),
direct AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least(m, vec_id), vec_id) AS component_id, coalesce(least(m, vec_id), vec_id) = vec_id AS kept
FROM v LEFT JOIN least_id ON least_id.a = vec_id LEFT JOIN direct ON direct.a = vec_id
""",
    "op12_source_divergence": r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
per_doc AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(ts) AS term FROM docs) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, sum(n) AS n FROM per_doc GROUP BY ALL HAVING count(*) >= 30),
posts AS (SELECT lang, source, term, sum(per_doc.n) AS n FROM per_doc JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY 1),
groups AS (SELECT DISTINCT lang, source FROM docs),
totals AS (SELECT lang, source, sum(n) AS total FROM posts GROUP BY ALL),
-- every kept term in every group
dense AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(p.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(p.n, 0)::HUGEINT + 5)) // (coalesce(t.total, 0)::HUGEINT + 5 * l.v) AS p,
    1 + (1000000000::HUGEINT * (k.n::HUGEINT + 5)) // (l.total::HUGEINT + 5 * l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang)
  LEFT JOIN posts p ON p.lang = g.lang AND p.source = g.source AND p.term = k.term
  LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM dense WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM rows)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
""",
    "op13_exact_dedup": r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t, row_number() OVER () AS r FROM documents)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER g = 1 AS kept, sha256(t) AS text_sha256
FROM t WINDOW g AS (PARTITION BY t ORDER BY doc_id NULLS LAST, r)
""",
}

_crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"


def _edit(way: str, cost: str, letter: str, line: str | None) -> str:
    """A way of a conversation's rows so far, one edit longer; null stays null."""
    return f"CASE WHEN {way} IS NOT NULL THEN {{'c': {way}.c + {cost}, 'a': {way}.a || '{letter}', 'r': {f'list_append({way}.r, {line})' if line else f'{way}.r'}}} END"


def _after_inserts(cols: str) -> str:
    user = lambda s: _edit(s, "3", "I", "'user:'")
    two = f"list_min([s2, {user('s0')}, {user('s1')}, {user('s3')}])"
    return f"SELECT {cols}, s0, s1, s2, list_min([s3, {_edit('s2', '3', 'I', chr(39) + 'assistant:' + chr(39))}]) AS s3 FROM (SELECT {cols}, s0, s1, {two} AS s2, s3 FROM layer)"


def _step(state: int) -> str:
    ways = [_edit(f"s{state}", "4", "D", None)]
    for s in {1: [0], 2: [0, 1, 3], 3: [2]}.get(state, []):
        ways.append(f"CASE WHEN NOT bad AND initial = '{' sua'[state]}' THEN {_edit(f's{s}', 'more', 'K', chr(34) + 'role' + chr(34) + ' || chr(58) || text')} END")
        if state > 1:
            ways.append(f"CASE WHEN NOT bad THEN {_edit(f's{s}', '3 + more', 'R', repr(('user:', 'assistant:')[state - 2]) + ' || text')} END")
    return f"list_min([{', '.join(ways)}]) AS s{state}"


_cols = "conv_id, n, i"
SQL["op11_conversation_repair"] = rf"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce("role", ' ') AS "role", coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
ways AS (SELECT *, {_crc} % 20 AS way FROM given),
harmed AS (
  SELECT conv_id, turn, CASE way WHEN 4 THEN 'user' ELSE "role" END AS "role", CASE way WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM ways, range(2) t(twice) WHERE way <> 0 AND (way = 3 OR twice = 0)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, "role", text) AS pos FROM harmed),
judged AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, "role", text ORDER BY pos) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS open, substr("role", 1, 1) AS initial, lag(substr("role", 1, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM placed),
line AS MATERIALIZED (SELECT conv_id, pos, "role", text, initial, blank OR again AS bad, CASE WHEN open THEN 3 ELSE 0 END AS more FROM judged),
figures AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
    count(*) FILTER (open AND NOT blank AND NOT again) AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY 1),
layer AS (
  SELECT conv_id, count(*) AS n, 0 AS i, {{'c': 0, 'a': '', 'r': []::VARCHAR[]}} AS s0, NULL::STRUCT(c INT, a VARCHAR, r VARCHAR[]) AS s1, NULL::STRUCT(c INT, a VARCHAR, r VARCHAR[]) AS s2, NULL::STRUCT(c INT, a VARCHAR, r VARCHAR[]) AS s3
  FROM line GROUP BY 1
  UNION ALL SELECT conv_id, n, i + 1, {', '.join(map(_step, range(4)))}
  FROM ({_after_inserts(_cols)}) w JOIN (SELECT conv_id AS cid, pos, "role", text, initial, bad, more FROM line) l ON w.conv_id IS NOT DISTINCT FROM l.cid AND l.pos = i + 1),
best AS (SELECT conv_id, list_min([s0, s3]) AS b FROM ({_after_inserts(_cols)}) WHERE i = n)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(array_to_string(b.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id
"""
