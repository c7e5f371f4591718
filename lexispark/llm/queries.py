"""The registered queries opN_<name> of this subpackage, over whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship
from . import decontaminate, embeddings, langid, licenses, lines, pieces, sharding, tokenfiles, turns, warc, whitening
from .common import table
from .minhash import near_duplicates
from .packing import pack

Query = Callable[[SparkSession, str], DataFrame]

#: The separator of token files: no id of the vocabulary, whose last, 49407, a text that quotes <|endoftext|> holds.
EOD = 65535


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that a benchmark item contaminates, a row for each such item."""
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "item_words", "matched", "coverage", F.size("tiles").cast("long").alias("n_tiles"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen arrivals, compacted and read back."""
    docs = table(spark, sf_dir, "documents")
    out = sharding.shard_round_trip(docs.withColumn("arrival", F.pmod(F.col("doc_id"), F.lit(16))), "arrival")
    return out.select("doc_id", "arrival", "n_chars", F.md5("text").alias("text_md5"))


def op4_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokenfiles.document_token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), eod=EOD)
    return counts.select("doc_id", "n_tokens")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs, usable=~langid.held_out())
    out = langid.identify(docs.select("doc_id", "text", langid.held_out().alias("held_out")), model, keep=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "dropped", F.md5("text").alias("text_md5"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs, licenses.train(docs))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer=public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.damaged_and_repaired(table(spark, sf_dir, "conversations"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    own = [
        op1_warc,
        op2_decontamination,
        op3_sharding,
        op4_embedding_neardup,
        op5_minhash,
        op6_token_counts,
        op7_language_id,
        op8_line_dedup,
        op9_license_scan,
        op10_best_fit_packing,
        op11_sentencepiece,
        op12_conversation_repair,
        op13_embedding_whitening,
    ]
    return {f.__name__: _shipped(f) for f in own}


def _shipped(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    run.__name__ = query.__name__
    return run


#: Words, distinct 4-word shingles, all links by shared shingles, and reachability.
OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS i FROM s p JOIN s q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id, min(r.b) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.a = d.doc_id GROUP BY d.doc_id
"""


#: The response of a payload is its largest page_id; base32 by groups of 40 bits.
OP1_SQL = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hexed FROM pages),
m AS (SELECT hexed, max(page_id) AS last FROM p GROUP BY hexed)
SELECT p.page_id, strlen(body) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(p.hexed, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8)))::BIGINT & 31)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN p.page_id = m.last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id = m.last THEN NULL ELSE m.last END AS refers_to, url
FROM p JOIN m ON p.hexed = m.hexed
"""

#: All pairs of equal label, and reachability over those at or above the threshold.
OP4_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
l AS (SELECT p.vec_id AS a, q.vec_id AS b FROM u p JOIN u q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.e) = len(q.e)
  WHERE p.norm > 0 AND q.norm > 0 AND list_inner_product(p.e, q.e) / (p.norm * q.norm) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT x.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, c.component_id = x.vec_id AS kept
FROM embeddings x JOIN c ON c.a = x.vec_id LEFT JOIN n ON n.a = x.vec_id
"""


#: What compaction must keep: every row once.
OP3_SQL = "SELECT doc_id, doc_id % 16 AS arrival, n_chars, md5(text) AS text_md5 FROM documents"

#: Templates by number of tokens and three leading tokens. In each leaf they are taken by falling number of documents: one
#: that is like an earlier leading one joins the first such, any other leads.
OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
x AS (SELECT doc_id, unnest(range(0, len(parts))) AS pos, parts FROM d WHERE doc_id IS NOT NULL AND text IS NOT NULL),
u AS (SELECT doc_id, pos, regexp_split_to_array(trim(translate(parts[pos + 1], chr(9) || chr(13) || chr(12) || chr(11), '    '), ' '), ' +') AS plain FROM x),
v AS (SELECT doc_id, pos, plain, list_transform(plain, lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) AS masked FROM u),
t AS (SELECT doc_id, pos, CASE WHEN 2 * len(list_filter(masked, lambda w: w = '<*>')) <= len(masked) THEN masked ELSE plain END AS w FROM v),
s AS (SELECT doc_id, pos, len(w) AS n, array_to_string(w[1:3], ' ') AS lead, array_to_string(w, ' ') AS tmpl, w[4:] AS rest FROM t WHERE len(w) >= 4),
f AS (SELECT n, lead, tmpl, count(DISTINCT doc_id) AS docs, min({'d': doc_id, 'p': pos}) AS first, any_value(rest) AS rest FROM s GROUP BY n, lead, tmpl),
o AS (SELECT *, row_number() OVER (PARTITION BY n, lead ORDER BY docs DESC, first.d, first.p) AS rn, count(*) OVER (PARTITION BY n, lead) AS of FROM f),
e AS (SELECT n, lead, 1::BIGINT AS rn, [{'t': tmpl, 'r': rest}] AS leads, tmpl, NULL::VARCHAR AS into_tmpl FROM o WHERE rn = 1 AND of > 1
  UNION ALL
  SELECT n, lead, rn, CASE WHEN len(alike) = 0 THEN list_append(leads, {'t': tmpl, 'r': rest}) ELSE leads END, tmpl, CASE WHEN len(alike) > 0 THEN alike[1].t END
  FROM (SELECT o.n, o.lead, o.rn, o.tmpl, o.rest, e.leads,
      list_filter(e.leads, lambda l: len(list_filter(range(1, len(l.r) + 1), lambda i: l.r[i] = o.rest[i])) >= ceil(0.7 * len(l.r) - 1e-9)) AS alike
    FROM e JOIN o ON o.n = e.n AND o.lead = e.lead AND o.rn = e.rn + 1)),
m AS (SELECT n, lead, tmpl, into_tmpl FROM e WHERE into_tmpl IS NOT NULL),
g AS (SELECT s.doc_id, s.pos, s.n, s.lead, coalesce(m.into_tmpl, s.tmpl) AS tmpl FROM s LEFT JOIN m ON m.n = s.n AND m.lead = s.lead AND m.tmpl = s.tmpl),
c AS (SELECT n, lead, tmpl, min(doc_id) AS first FROM g GROUP BY n, lead, tmpl HAVING count(DISTINCT doc_id) >= 2),
z AS (SELECT g.doc_id, list_sort(list(DISTINCT g.pos)) AS dropped FROM g JOIN c ON g.n = c.n AND g.lead = c.lead AND g.tmpl = c.tmpl WHERE g.doc_id <> c.first GROUP BY g.doc_id)
SELECT d.doc_id, len(d.parts) AS n_lines, coalesce(z.dropped, []) AS dropped,
  md5(array_to_string(list_transform(list_filter(range(1, len(d.parts) + 1), lambda i: NOT list_contains(coalesce(z.dropped, []), i - 1)), lambda i: d.parts[i]), chr(10))) AS text_md5
FROM d LEFT JOIN z ON z.doc_id = d.doc_id
"""


#: CRC-32 bit by bit; the cheapest edits by recursion over the turns, keeping the best of each state.
OP12_SQL = r"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
      lambda c: [ascii(c)::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda a, b: xor(xor(a, b) >> 1, CASE WHEN xor(a, b) & 1 = 1 THEN 3988292384::UBIGINT ELSE 0 END)), 4294967295::UBIGINT) % 20 AS kind
  FROM conversations),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t, role[1:1] AS i FROM d),
s AS (SELECT *, t = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 AS seen, lag(i) OVER (PARTITION BY conv_id ORDER BY rn) AS ahead FROM o),
f AS (
  SELECT *, NOT blank AND seen AS duplicate, NOT blank AND NOT seen AND t[-1:] NOT IN ('.', '!', '?') AS truncated, ahead IS NOT NULL AND (ahead || i) NOT IN ('su', 'ua', 'au') AS illegal FROM s),
p AS (
  SELECT conv_id, rn, role, text, i, blank OR duplicate AS must, CASE WHEN truncated THEN 3 ELSE 0 END AS pay FROM f),
n AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
    count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal, count(*) AS rows FROM f GROUP BY conv_id),
-- One row for each conversation, number of turns read and state (0 nothing, 1 after s, 2 after u, 3 after a): least cost and audit, with the lines so far.
w AS (
  SELECT conv_id, 0::BIGINT AS rn, x.st, x.cost, x.audit, x.lines FROM n, (VALUES (0, 0, '', []::VARCHAR[]), (2, 3, 'I', ['user:']), (3, 6, 'II', ['user:', 'assistant:'])) x(st, cost, audit, lines)
  UNION ALL
  SELECT conv_id, rn, st, cost, audit, lines FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, st ORDER BY cost, audit) AS place FROM (
      SELECT conv_id, rn, unnest(
        [{st: st, cost: cost, audit: audit, lines: lines}] ||
        CASE WHEN st <> 2 THEN [{st: 2, cost: cost + 3, audit: audit || 'I', lines: lines || ['user:']}, {st: 3, cost: cost + 6, audit: audit || 'II', lines: lines || ['user:', 'assistant:']}]
          ELSE [{st: 3, cost: cost + 3, audit: audit || 'I', lines: lines || ['assistant:']}] END, recursive := true)
      FROM (
        SELECT w.conv_id, p.rn, unnest(
          [{st: w.st, cost: w.cost + 4, audit: w.audit || 'D', lines: w.lines}] ||
          CASE WHEN NOT p.must AND p.i = 's' AND w.st = 0 THEN [{st: 1, cost: w.cost + p.pay, audit: w.audit || 'K', lines: w.lines || [p.role || ':' || p.text]}] ELSE [] END ||
          CASE WHEN NOT p.must THEN [{st: CASE WHEN w.st = 2 THEN 3 ELSE 2 END,
            cost: w.cost + p.pay + CASE WHEN p.i = CASE WHEN w.st = 2 THEN 'a' ELSE 'u' END THEN 0 ELSE 3 END,
            audit: w.audit || CASE WHEN p.i = CASE WHEN w.st = 2 THEN 'a' ELSE 'u' END THEN 'K' ELSE 'R' END,
            lines: w.lines || [CASE WHEN p.i = CASE WHEN w.st = 2 THEN 'a' ELSE 'u' END THEN p.role WHEN w.st = 2 THEN 'assistant' ELSE 'user' END || ':' || p.text]}] ELSE [] END, recursive := true)
        FROM w JOIN p ON p.conv_id IS NOT DISTINCT FROM w.conv_id AND p.rn = w.rn + 1))) WHERE place = 1),
b AS (
  SELECT w.conv_id, w.cost, w.audit, w.lines, row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost, w.audit) AS place
  FROM w JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.rows = w.rn WHERE w.st IN (0, 3))
SELECT c.conv_id, coalesce(n.gaps, 0) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate, coalesce(n.truncated, 0) AS truncated, coalesce(n.illegal, 0) AS illegal,
  coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(array_to_string(b.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.place = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_conversation_repair": OP12_SQL, "op3_sharding": OP3_SQL, "op8_line_dedup": OP8_SQL, "op1_warc": OP1_SQL, "op4_embedding_neardup": OP4_SQL, "op5_minhash": OP5_SQL}
