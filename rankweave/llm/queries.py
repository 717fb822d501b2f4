"""Registered queries of the ten operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm import alignment, byte_bpe
from rankweave.llm.chat_format import chat_windows, read_back
from rankweave.llm.decontaminate import contamination
from rankweave.llm.line_dedup import without_shared_lines
from rankweave.llm.minhash_dedup import near_duplicates
from rankweave.llm.mixing import mixed
from rankweave.llm.quality_classifier import quality_scores
from rankweave.llm.quality_rules import quality_by_rules
from rankweave.llm.secret_scan import secrets
from rankweave.llm.shared import table
from rankweave.llm.structure_repair import repaired_conversations
from rankweave.llm.substring_dedup import without_repeats
from rankweave.llm.url_filter import filtered_urls


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of all documents at two-word shingles and a similarity of 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 1 THEN [ws[1]] WHEN len(ws) = 0 THEN []
    ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.size + y.size - c)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT reach.id, edge.b FROM reach JOIN edge ON edge.a = reach.other)
SELECT d.doc_id, coalesce(n.size, 0)::BIGINT AS n_shingles, r.least AS component_id, d.doc_id = r.least AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(other) AS least FROM reach GROUP BY id) r ON r.id = d.doc_id
"""


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the windows of 13 words that an earlier document has."""
    kept = without_repeats(table(spark, sf_dir, "documents"), length=13)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
low AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN low USING (g) WHERE m < doc_id),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents inside ten-word windows of the benchmark."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("item_ids", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), ids.alias("items_sha256"), "contaminated")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)),
hit AS (SELECT doc_id, n, i, item_id FROM dw JOIN bw USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS c FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS k, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS l FROM hit GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(c, 0) AS n_hit, coalesce(k, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(c, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, whose texts are control strings; digests of what the windows say.

    A digest of a whole conversation needs its text in one row; the windows themselves do not.
    """
    probe = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{probe}'), (-1L, 1L, 'assistant', '{probe}') AS t(conv_id, turn, role, text)")
    said = read_back(chat_windows(turns.unionByName(extra)))
    whole = said.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "turns", "losses"))).alias("windows"), F.sum("formatted_chars").alias("formatted_chars"))
    lines = F.transform(F.flatten("windows.turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    whole = whole.select("conv_id", "formatted_chars", F.size(F.flatten("windows.turns")).cast("long").alias("n_turns"), F.array_join(lines, "").alias("said"), F.array_join(F.flatten("windows.losses"), "").alias("learnt"))
    return whole.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars")


OP1_SQL = r"""
WITH t0 AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
t1 AS (SELECT *, row_number() OVER w AS place FROM t0 WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
t2 AS (SELECT *, place = 1 AND role = 'system' AS sys, len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_\x20\x09-\x0D]')) + 4 AS n,
  length(text) + length(role) + 8 + len(regexp_extract_all(text, '[<][~]*(?:/?s>|\|)|\[[~]*/?INST\]')) + len(regexp_extract_all(text, '[<][~]*</?SYS>>')) AS chars FROM t1),
t3 AS (SELECT *, sum(CASE WHEN sys THEN 0 ELSE n END) OVER (PARTITION BY conv_id ORDER BY place) AS stop, coalesce(max(CASE WHEN sys THEN n END) OVER (PARTITION BY conv_id), 0) AS kept FROM t2),
t4 AS (SELECT *, stop - CASE WHEN sys THEN 0 ELSE n END AS start, greatest(512 - 128 - kept, 1) AS room FROM t3),
t5 AS (SELECT *, CASE WHEN sys THEN 0 ELSE 2 * (start // room) + CASE WHEN stop > (start // room + 1) * room THEN 1 ELSE 0 END END AS win FROM t4),
opens AS (SELECT conv_id, win, min(start) AS at, least(128, greatest(0, 512 - any_value(kept) - sum(n))) AS reach FROM t5 WHERE NOT sys GROUP BY ALL),
again AS (SELECT t5.conv_id, sum(chars) AS c FROM t5 JOIN opens o ON o.conv_id = t5.conv_id AND CASE WHEN sys THEN o.win > 0 ELSE o.at BETWEEN t5.start + 1 AND t5.start + o.reach END GROUP BY 1)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(chars) + coalesce(any_value(c), 0))::BIGINT AS formatted_chars
FROM t5 LEFT JOIN again USING (conv_id) GROUP BY conv_id
"""

def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes, posterior and verdict of all documents."""
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))
    return quality_by_rules(table(spark, sf_dir, "documents")).select(*columns)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in all documents, judged by a forest that learns from those whose form decides; values as digests."""
    found = secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "place", F.length("value").alias("n_chars"), F.sha2("value", 256).alias("value_sha256"), "probability")


def good_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of good documents: of quality, and not toxic."""
    return table(spark, sf_dir, "labels").select("doc_id", F.expr("CAST(quality = 1 AND toxic = 0 AS INT)").alias("good"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by both views."""
    scores = quality_scores(table(spark, sf_dir, "documents"), good_labels(spark, sf_dir))
    return scores.select("doc_id", *(F.round(c, 6).alias(c) for c in ("text_score", "meta_score", "quality")), "kept")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that an earlier one has; texts as digests."""
    kept = without_shared_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_deleted", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against a dated list; dates and list follow from the pages, which have neither.

    A page was fetched on the day 2024-01-01 + (page_id * 13) % 366. A third of the hosts is listed
    (by the smallest page_id m of the host): added, and half of them removed and added again later;
    of the pages every 50th has its path listed.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.expr("date_add(DATE '2024-01-01', CAST((page_id * 13) % 366 AS INT))"))
    hosts = pages.select(F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("pattern"), "page_id").groupBy("pattern").agg(F.min("page_id").alias("m")).where("m % 3 = 0 AND pattern != ''")
    days = {"add": "(m * 7) % 300", "remove": "(m * 7) % 300 + 20 + m % 50", "add again": "(m * 7) % 300 + 100 + m % 50"}
    entries = hosts.select("pattern", F.explode(F.expr("if(m % 2 = 0, array(" + ", ".join(f"struct('{k.split()[0]}' AS action, {v} AS d)" for k, v in days.items()) + f"), array(struct('add' AS action, {days['add']} AS d)))")).alias("e"))
    entries = entries.select("pattern", "e.action", F.expr("date_add(DATE '2024-01-01', CAST(e.d AS INT))").alias("dated"))
    paths = pages.where("page_id % 50 = 0").select(F.regexp_extract("url", "^https?://([^?#]*[^?#/])", 1).alias("pattern"), F.lit("add").alias("action"), F.expr("date_add(DATE '2024-01-01', CAST(page_id % 200 AS INT))").alias("dated"))
    return filtered_urls(captures, entries.unionByName(paths.where("pattern LIKE '%/%'")))


OP7_SQL = r"""
WITH cap AS (SELECT DISTINCT page_id, url, DATE '2024-01-01' + ((page_id * 13) % 366)::INT AS fetched FROM pages),
host AS (SELECT pattern, min(page_id) AS m FROM (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS pattern FROM pages) WHERE pattern != '' GROUP BY pattern HAVING min(page_id) % 3 = 0),
entry AS (SELECT pattern, 1 AS listed, (m * 7) % 300 AS d FROM host UNION ALL
  SELECT pattern, 0, (m * 7) % 300 + 20 + m % 50 FROM host WHERE m % 2 = 0 UNION ALL SELECT pattern, 1, (m * 7) % 300 + 100 + m % 50 FROM host WHERE m % 2 = 0 UNION ALL
  SELECT regexp_extract(url, '^https?://([^?#]*[^?#/])', 1), 1, page_id % 200 FROM pages WHERE page_id % 50 = 0 AND regexp_extract(url, '^https?://([^?#]*[^?#/])', 1) LIKE '%/%'),
one AS (SELECT lower(pattern) AS pattern, DATE '2024-01-01' + d::INT AS dated, max(listed) AS listed FROM entry GROUP BY 1, 2),
span AS (SELECT pattern, listed, dated AS low, lead(dated) OVER (PARTITION BY pattern ORDER BY dated) AS high FROM one),
part AS (SELECT *, string_split(regexp_replace(regexp_replace(lower(url), '^https?://', ''), '[?#].*$', ''), '/') AS p FROM cap),
key AS (SELECT page_id, url, fetched, unnest(list_distinct(list_concat(
  list_transform(range(1, len(string_split(p[1], '.')) + 1), lambda i: array_to_string(string_split(p[1], '.')[i:], '.')),
  list_transform(range(2, len(list_filter(p, lambda x: x != '')) + 1), lambda i: array_to_string(list_filter(p, lambda x: x != '')[1:i], '/'))))) AS pattern FROM part),
hit AS (SELECT page_id, url, fetched, count(DISTINCT pattern) AS n_entries, min(pattern) AS pattern FROM key JOIN span USING (pattern) WHERE listed = 1 AND fetched >= low AND (high IS NULL OR fetched < high) GROUP BY ALL)
SELECT cap.page_id, cap.url, cap.fetched, coalesce(n_entries, 0) AS n_entries, pattern, pattern IS NOT NULL AS blocked FROM cap LEFT JOIN hit USING (page_id, url, fetched)
"""


def tokens_with_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, tokens, ids_sha256, decoded_sha256) of whole texts."""
    back = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    ids = F.array_join(F.col("tokens").cast("array<string>"), " ")
    return back.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), "tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again, as digests."""
    return tokens_with_digests(table(spark, sf_dir, "documents")).drop("tokens")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents aligned between the byte-level BPE and the piece model, as digests and counts."""
    paths = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    shared = alignment.aligner(spark, *paths, public_tokenizers.PATTERN)
    aligned = alignment.align(table(spark, sf_dir, "documents"), shared, digest=True)
    out = alignment.with_link_counts(aligned.withColumn("n_groups", F.size("links").cast("long")), shared)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed so that sources weigh 3, 1, 2 in turn, by 150 % of all words."""
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by a checksum of their turns, and repaired; repaired texts as digests."""
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "coalesce(role, ' ') AS role", "coalesce(text, ' ') AS text", "crc32(concat(coalesce(CAST(conv_id AS STRING), ' '), ':', coalesce(CAST(turn AS STRING), ' '))) % 20 AS damage")
    damaged = rows.selectExpr(
        "conv_id", "turn", "if(damage = 4, 'user', role) AS role", "CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '') ELSE text END AS text",
        "damage > 0 AS present", "explode(sequence(1, if(damage = 3, 2, 1))) AS copy",
    )
    out = repaired_conversations(damaged, present_col="present")
    lines = F.transform(F.filter("repaired", lambda e: e["edit"] != "D"), lambda e: F.concat(e["role"], F.lit(":"), e["text"]))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))


# The checksum goes bit by bit; the repair goes row by row, with the least (cost, audit) of each of the four states.
OP13_SQL = r"""
WITH RECURSIVE key AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
crc AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(k, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda c, x: CASE WHEN xor(c, x) & 1 = 1 THEN xor(xor(c, x) >> 1, 3988292384) ELSE xor(c, x) >> 1 END), 4294967295) % 20 AS h FROM key),
damaged AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM crc WHERE h <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
  lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM damaged),
fault AS (SELECT *, left(role, 1) AS i, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'b' WHEN seen > 1 THEN 'd'
  WHEN regexp_matches(text, '[.!?][ 	-
]*$') THEN '' ELSE 't' END AS f FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) AS seen FROM placed)),
told AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate,
  count(*) FILTER (f = 't') AS truncated, count(*) FILTER (before IS NOT NULL AND left(before, 1) || i NOT IN ('su', 'ua', 'au')) AS illegal, max(place) AS n FROM fault GROUP BY conv_id),
step AS (SELECT conv_id, 0::BIGINT AS place, {'c': 0::BIGINT, 'a': ''} AS v0, NULL::STRUCT(c BIGINT, a VARCHAR) AS v1, {'c': 2::BIGINT, 'a': 'I'} AS v2, {'c': 4::BIGINT, 'a': 'II'} AS v3 FROM told
  UNION ALL
  SELECT conv_id, place, w0, w1, w2, list_min([x for x in [w3, CASE WHEN w2 IS NOT NULL THEN {'c': w2.c + 2, 'a': w2.a || 'I'} END] if x IS NOT NULL]) FROM (
    SELECT conv_id, place, w0, w1, w3, list_min([x for x in [w2, CASE WHEN w0 IS NOT NULL THEN {'c': w0.c + 2, 'a': w0.a || 'I'} END, CASE WHEN w1 IS NOT NULL THEN {'c': w1.c + 2, 'a': w1.a || 'I'} END, CASE WHEN w3 IS NOT NULL THEN {'c': w3.c + 2, 'a': w3.a || 'I'} END] if x IS NOT NULL]) AS w2 FROM (
      SELECT s.conv_id, s.place + 1 AS place, {'c': v0.c + 3, 'a': v0.a || 'D'} AS w0,
        list_min([x for x in [CASE WHEN v1 IS NOT NULL THEN {'c': v1.c + 3, 'a': v1.a || 'D'} END, CASE WHEN i = 's' AND f IN ('', 't') THEN {'c': v0.c + t, 'a': v0.a || 'K'} END] if x IS NOT NULL]) AS w1,
        list_min([x for x in [{'c': v2.c + 3, 'a': v2.a || 'D'}, CASE WHEN f IN ('', 't') THEN {'c': v0.c + u, 'a': v0.a || ul} END, CASE WHEN f IN ('', 't') AND v1 IS NOT NULL THEN {'c': v1.c + u, 'a': v1.a || ul} END, CASE WHEN f IN ('', 't') THEN {'c': v3.c + u, 'a': v3.a || ul} END] if x IS NOT NULL]) AS w2,
        list_min([x for x in [{'c': v3.c + 3, 'a': v3.a || 'D'}, CASE WHEN f IN ('', 't') THEN {'c': v2.c + b, 'a': v2.a || bl} END] if x IS NOT NULL]) AS w3
      FROM step s JOIN (SELECT *, CASE f WHEN 't' THEN 1 ELSE 0 END AS t, CASE i WHEN 'u' THEN 0 ELSE 2 END + CASE f WHEN 't' THEN 1 ELSE 0 END AS u, CASE i WHEN 'u' THEN 'K' ELSE 'R' END AS ul,
        CASE i WHEN 'a' THEN 0 ELSE 2 END + CASE f WHEN 't' THEN 1 ELSE 0 END AS b, CASE i WHEN 'a' THEN 'K' ELSE 'R' END AS bl FROM fault) r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.place = s.place + 1))),
best AS (SELECT t.*, least(v0, v3) AS cell FROM told t JOIN step s ON s.conv_id IS NOT DISTINCT FROM t.conv_id AND s.place = t.n),
letter AS (SELECT conv_id, nr, e, count(*) FILTER (e <> 'I') OVER w AS place, count(*) FILTER (e <> 'D') OVER w AS said FROM (
  SELECT conv_id, unnest(range(1, length(cell.a) + 1)) AS nr, unnest(string_split(cell.a, '')) AS e FROM best WHERE cell.a <> '') WINDOW w AS (PARTITION BY conv_id ORDER BY nr)),
shift AS (SELECT l.conv_id, bool_or(l.said = 1 AND l.e = 'K' AND f.i = 's') AS sys FROM letter l LEFT JOIN fault f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.place = l.place WHERE l.e <> 'D' GROUP BY l.conv_id),
line AS (SELECT l.conv_id, string_agg(CASE WHEN l.e = 'K' THEN f.role WHEN (l.said - CASE WHEN s.sys THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN l.e = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY l.nr) AS t
  FROM letter l JOIN shift s ON s.conv_id IS NOT DISTINCT FROM l.conv_id LEFT JOIN fault f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.place = l.place WHERE l.e <> 'D' GROUP BY l.conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cell.c, 0) AS cost, coalesce(cell.a, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN line ON line.conv_id IS NOT DISTINCT FROM c.conv_id
"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_format, op2_quality_rules, op3_decontamination, op4_secret_scan, op5_quality_classifier, op6_line_dedup, op7_url_filter,
        op8_substring_dedup, op9_minhash_dedup, op10_byte_bpe, op11_token_alignment, op12_mix_sources, op13_structure_repair,
    )
}
ORACLE_SQL = {"op1_chat_format": OP1_SQL, "op3_decontamination": OP3_SQL, "op7_url_filter": OP7_SQL, "op8_substring_dedup": OP8_SQL, "op9_minhash_dedup": OP9_SQL, "op13_structure_repair": OP13_SQL}
