"""Queries of extraction, vocabulary, questions and contexts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from rankweave.operators import context as A
from rankweave.operators import extract as X
from rankweave.operators import question as Q
from rankweave.operators import vocab as V
from rankweave.plans.register import Plans
from rankweave.plans.standins import table, terms_sql
from rankweave.sources import runs as S

plans = Plans()


def records(spark, d):
    """Documents as records: the first half of the lines are ingredients, the rest steps."""
    line = X.clean_lines(F.col("text"))
    t = table(spark, d, "documents").withColumn("l", line).withColumn("h", F.floor(F.size("l") / 2).cast("int"))
    return t.select(F.col("source"), F.col("doc_id").cast("string").alias("record_id"), F.get("l", F.lit(0)).alias("title"), F.slice("l", F.lit(1), F.col("h")).alias("ingredient_lines"), F.expr("slice(l, h + 1, size(l))").alias("step_lines"), F.col("lang").alias("servings_hint"), F.lit(None).cast("string").alias("time_hint"))


LINES = r"lines AS (SELECT doc_id, list_filter(list_transform(string_split_regex(replace(text, chr(9), ' '), '\r\n|[\n\r\x0B\x0C]'), lambda x: regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), ' {2,}', ' ', 'g')), lambda x: x != '') AS l FROM documents)"


@plans(f"WITH {LINES} SELECT doc_id, len(l) AS n_lines, md5(array_to_string(l, chr(10))) AS digest FROM lines")
def x01_clean_lines(spark, d):
    t = table(spark, d, "documents").select("doc_id", X.clean_lines(F.col("text")).alias("l"))
    return t.select("doc_id", F.size("l").cast("long").alias("n_lines"), F.md5(F.array_join("l", "\n")).alias("digest"))


@plans(f"""WITH {LINES}, j AS (SELECT doc_id, l, array_to_string(l, ' ') AS t FROM lines)
SELECT doc_id FROM j WHERE len(l) >= 3 AND (regexp_matches(t, '{X.INGREDIENT_HEADER}') OR regexp_matches(t, '{X.METHOD_HEADER}') OR (regexp_matches(t, '{X.VERB}') AND length(t) > 120))""")
def x02_classify_pages(spark, d):
    t = table(spark, d, "documents").select("doc_id", X.clean_lines(F.col("text")).alias("l"))
    return t.where(X.is_record_page(F.col("l"))).select("doc_id")


@plans()
def x03_split_sections(spark, d):
    t = table(spark, d, "documents").select(F.col("source").alias("run"), F.col("doc_id").alias("page_no"), X.clean_lines(F.col("text")).alias("lines"))
    return X.split_sections(t)


@plans(f"""WITH {LINES}, j AS (SELECT source, doc_id, l, array_to_string(l, ' ') AS t FROM lines JOIN documents USING (doc_id))
SELECT source AS run, count(*) AS n_units_total, count(*) FILTER (len(l) > 0) AS n_units_read, count(*) FILTER (len(l) = 0) AS n_units_empty, coalesce(list(doc_id ORDER BY doc_id) FILTER (len(l) = 0), []) AS empty_units, sum(length(array_to_string(l, chr(10))))::BIGINT AS n_chars,
count(*) FILTER (len(l) >= 3 AND (regexp_matches(t, '{X.INGREDIENT_HEADER}') OR regexp_matches(t, '{X.METHOD_HEADER}') OR (regexp_matches(t, '{X.VERB}') AND length(t) > 120))) AS n_records FROM j GROUP BY source""")
def x04_run_counters(spark, d):
    t = table(spark, d, "documents").select(F.col("source").alias("run"), F.col("doc_id").alias("page_no"), X.clean_lines(F.col("text")).alias("lines"))
    return X.run_counters(t)


@plans()
def x05_html_text(spark, d):
    return X.html_text(table(spark, d, "pages"))


@plans()
def x06_jsonld_nodes(spark, d):
    """Nodes of blocks that are written from each page's first lines, as the given pages have none."""
    p = X.html_text(table(spark, d, "pages")).select("page_id", "url", F.to_json(F.struct(F.lit("Recipe").alias("@type"), F.col("title").alias("name"), F.slice("lines", 2, 3).alias("recipeIngredient"), F.slice("lines", 5, 2).alias("recipeInstructions"))).alias("j"))
    return X.jsonld_nodes(p.select("page_id", "url", F.concat(F.lit('<script type="application/ld+json">'), "j", F.lit("</script>")).alias("html")))


def order_pages(spark, d):
    """A page for each order, of its parts: a third with the record as JSON-LD, beside a block that is broken, a third as text, a third with neither."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(parts, "l_partkey")
    o = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "p_name"))).alias("l"))
    many = lambda f: F.array_join(F.transform("l", f), "\n")
    node = F.struct(
        F.array(F.lit("Thing"), F.lit("RECIPE")).alias("@type"), F.format_string("Order %s", "l_orderkey").alias("name"),
        F.transform("l", lambda x: F.format_string("%s cups %s", x["l_linenumber"], x["p_name"])).alias("recipeIngredient"),
        F.transform("l", lambda x: F.struct(F.lit("HowToStep").alias("@type"), F.format_string("Add the %s.", x["p_name"]).alias("text"))).alias("recipeInstructions"),
        F.size("l").alias("recipeYield"),
    )
    data = F.concat(F.lit('<script type="application/ld+json">{"@graph": [{broken</script><script type="application/ld+json">'), F.to_json(F.struct(F.array(node).alias("@graph"))), F.lit("</script>"))
    item = many(lambda x: F.format_string("<li>%s cups\t%s</li>", x["l_linenumber"], x["p_name"]))
    step = many(lambda x: F.format_string("<p>Stir the %s in and leave it, as long as it takes, until nothing moves.</p>", x["p_name"]))
    third = F.col("l_orderkey") % 3
    html = F.concat(
        F.format_string("<html><head><title>Page %s</title>", "l_orderkey"), F.when(third == 0, data).otherwise(""), F.format_string("</head><body><nav>menu</nav><h1>Order  %s</h1>\n", "l_orderkey"),
        F.when(third == 1, F.concat(F.lit("<ul>"), item, F.lit("</ul><![broken "), step)).otherwise(item),
        F.format_string('<a href="/order/%s#top">the next\n one</a><a href="?page=2">more</a><a href="#here">here</a><a href="http://elsewhere.example/">out</a><a href="mailto:a@b.example">mail</a></body></html>', F.col("l_orderkey") + 1),
    )
    return o.select(F.col("l_orderkey").alias("page_id"), F.format_string("http://shop.example/order/%s", "l_orderkey").alias("url"), html.alias("html"))


ORDER_PAGES = """WITH l AS (SELECT l_orderkey AS k, list(struct_pack(n := l_linenumber, p := p_name) ORDER BY l_linenumber, p_name) AS l FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
pg AS (SELECT k AS page_id, 'http://shop.example/order/' || k AS url, 'Order ' || k AS title, k % 3 AS third, l, list_transform(l, lambda x: x.n || ' cups ' || x.p) AS items FROM l),
ld AS (SELECT page_id, url, 0::INT AS node_ord, title, items AS ingredient_lines, list_transform(l, lambda x: 'Add the ' || x.p || '.') AS step_lines, len(l)::VARCHAR AS servings_hint, 'json-ld' AS detected_by FROM pg WHERE third = 0 AND len(l) >= 2),
tx AS (SELECT page_id, url, 0::INT AS node_ord, title, items AS ingredient_lines, list_transform(l, lambda x: 'Stir the ' || x.p || ' in and leave it, as long as it takes, until nothing moves.') AS step_lines, NULL::VARCHAR AS servings_hint, 'heuristic-text' AS detected_by FROM pg WHERE third = 1 AND len(l) >= 3) """
RECORD_COLUMNS = ("page_id", "url", "node_ord", "title", "ingredient_lines", "step_lines", "servings_hint", "detected_by")


@plans(ORDER_PAGES + "SELECT page_id, url, title, items FROM pg")
def x05_text_of_records(spark, d):
    """Titles and unit lines of orders' pages, past a mark that the parser gives up on."""
    return X.html_text(order_pages(spark, d)).select("page_id", "url", "title", F.filter("lines", lambda x: x.rlike("^[0-9]+ cups ")).alias("items"))


@plans(ORDER_PAGES + "SELECT * FROM ld")
def x07_jsonld_records(spark, d):
    return X.jsonld_records(X.jsonld_nodes(order_pages(spark, d))).select(*RECORD_COLUMNS)


@plans(ORDER_PAGES + "SELECT * FROM tx")
def x08_text_records(spark, d):
    return X.text_records(X.html_text(order_pages(spark, d))).select(*RECORD_COLUMNS)


@plans(ORDER_PAGES + "SELECT * FROM ld UNION ALL SELECT * FROM tx")
def x09_records_from_pages(spark, d):
    """Records of orders' pages; the given pages have none."""
    return X.records_from_pages(order_pages(spark, d)).select(*RECORD_COLUMNS)


@plans(ORDER_PAGES + "SELECT page_id, url AS base, unnest(['http://shop.example/order/' || (page_id + 1), url || '?page=2']) AS href, unnest(['the next one', 'more']) AS text FROM pg")
def x10_links_of_records(spark, d):
    return X.extract_links(order_pages(spark, d))


# Sections: a header, unit lines and steps of each order as the lines of a page.
@plans("""WITH l AS (SELECT l_orderkey AS k, list(struct_pack(n := l_linenumber, p := p_name) ORDER BY l_linenumber, p_name) AS l FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
s AS (SELECT k % 7 AS run, k AS page_no, 'Ingredients of order ' || k AS title, list_transform(l, lambda x: x.n || ' cups ' || x.p) AS ing, list_transform(l, lambda x: 'Add the ' || x.p || '.') AS st, len(l) AS n FROM l)
SELECT run, page_no, printf('r_%04d', row_number() OVER (PARTITION BY run ORDER BY page_no)) AS record_id,
  title, ing AS ingredient_lines, st AS step_lines, 'Serves ' || n AS servings_hint, NULL::VARCHAR AS time_hint, 'headings' AS detected_by FROM s""")
def x03_sections_of_orders(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    o = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(parts, "l_partkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "p_name"))).alias("l"))
    lines = F.concat(
        F.array(F.format_string("Ingredients of order %s", "l_orderkey"), F.format_string("Serves %s", F.size("l"))), F.transform("l", lambda x: F.format_string("%s cups %s", x["l_linenumber"], x["p_name"])),
        F.array(F.lit("Method")), F.transform("l", lambda x: F.format_string("Add the %s.", x["p_name"])),
    )
    return X.split_sections(o.select((F.col("l_orderkey") % 7).alias("run"), F.col("l_orderkey").alias("page_no"), lines.alias("lines"))).drop("raw_text")


@plans()
def x10_extract_links(spark, d):
    return X.extract_links(table(spark, d, "pages"))


def _sql_list(words):
    return ", ".join(f"'{w}'" for w in words)


SCORE = rf"""u AS (SELECT page_id, url, regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path FROM pages),
p AS (SELECT *, list_filter(string_split(lower(path), '/'), lambda x: x != '') AS parts FROM u),
s AS (SELECT page_id, url, CASE WHEN path = '' OR regexp_matches(path, '{X.JUNK_PATH}') THEN 0 WHEN regexp_matches(url, '{X.PAGINATION}') THEN 1 WHEN len(parts) = 0 THEN 0
WHEN list_has_any(parts, [{_sql_list(X.INDEX_SEGMENTS)}]) OR regexp_matches(parts[-1], '{X.PLURAL_SLUG}') THEN 2
WHEN list_contains(parts, 'recipe') OR list_contains(parts, 'recipes') THEN CASE WHEN coalesce(nullif(list_position(parts, 'recipe'), 0), list_position(parts, 'recipes')) = len(parts) THEN 1 WHEN contains(parts[-1], '-') THEN 10 ELSE 6 END
WHEN contains(parts[-1], '-') AND length(parts[-1]) > 8 THEN 7 ELSE 0 END AS score FROM p)"""


@plans(f"WITH {SCORE} SELECT page_id, score FROM s")
def x11_score_links(spark, d):
    return table(spark, d, "pages").select("page_id", X.link_score(F.col("url"), F.lit("")).cast("int").alias("score"))


@plans(f"WITH {SCORE} SELECT url, max(score) AS score FROM s WHERE score > 0 AND url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0) GROUP BY url ORDER BY score DESC, url LIMIT 500")
def x12_frontier(spark, d):
    p = table(spark, d, "pages")
    return X.frontier(X.score_links(p.select(F.col("url").alias("href"), F.lit("").alias("text"))), p.where("page_id % 3 = 0").select("url"), 500)


@plans(r"""WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host FROM pages), h AS (SELECT host, min(page_id) % 4 AS k FROM p WHERE host != '' GROUP BY host)
SELECT page_id, url, CASE WHEN host = '' THEN 'scheme or host' WHEN k IN (0, 2) THEN 'private address' WHEN k = 3 THEN 'unresolved' END AS reason FROM p LEFT JOIN h USING (host)""")
def x13_filter_public_urls(spark, d):
    """Hosts have public, private or no addresses, by their first page."""
    p = table(spark, d, "pages").select("page_id", "url")
    hosts = p.groupBy(F.lower(F.regexp_extract("url", "^https?://([^/?#:]+)", 1)).alias("host")).agg((F.min("page_id") % 4).alias("k")).where("host != '' AND k != 3")
    hosts = hosts.select("host", F.get(F.array(*map(F.lit, ("10.0.0.1", "93.184.216.34", "127.0.0.1"))), F.col("k").cast("int")).alias("ip"))
    reason = F.when(F.col("reason").isin("scheme", "no host"), "scheme or host").otherwise(F.col("reason"))
    return X.filter_public_urls(p, hosts).select("page_id", "url", reason.alias("reason"))


@plans(f"""WITH {LINES}, r AS (SELECT doc_id, l, len(l) // 2 AS h, lang FROM lines JOIN documents USING (doc_id))
SELECT source, md5(string_agg(t, chr(1) ORDER BY doc_id)) AS digest FROM (SELECT doc_id, array_to_string(list_concat([coalesce(nullif(l[1], ''), '(untitled)'), lang], CASE WHEN h > 0 THEN list_concat(['Ingredients:'], list_transform(l[:h], lambda x: '- ' || x)) ELSE [] END,
CASE WHEN len(l) > h THEN list_concat(['Method:'], list_transform(range(h + 1, len(l) + 1), lambda i: (i - h) || '. ' || l[i])) ELSE [] END), chr(10)) AS t FROM r) JOIN documents USING (doc_id) GROUP BY source""")
def x14_render_records(spark, d):
    """A digest of each source's texts in order, taken text by text; no text of a whole source is made."""
    r = records(spark, d).select("source", F.col("record_id").cast("long").alias("n"), X.render_records(None).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, digest, mark = None, None, b""
        done = lambda: pa.RecordBatch.from_arrays([pa.array([source], pa.string()), pa.array([digest.hexdigest()])], ["source", "digest"])
        for batch in batches:
            for s, t in zip(batch.column(0), batch.column(1), strict=True):
                if digest is None or s.as_py() != source:
                    if digest is not None:
                        yield done()
                    source, digest, mark = s.as_py(), hashlib.md5(), b""
                if t.is_valid:
                    digest.update(mark + t.as_py().encode())
                    mark = b"\1"
        if digest is not None:
            yield done()

    return r.repartition("source").sortWithinPartitions("source", "n", "t").select("source", "t").mapInArrow(run, "source string, digest string")


@plans(f"SELECT doc_id, array_to_string(CASE WHEN list_contains(t, 'deep fry') THEN list_filter(t, lambda x: x != 'fry') ELSE t END, ',') AS terms FROM (SELECT doc_id, coalesce({terms_sql(X.ACTIONS)}, []) AS t FROM documents)")
def x15_extract_terms(spark, d):
    """Which of all actions each document names."""
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(X.extract_terms(F.col("text"), X.ACTIONS)), ",").alias("terms"))


@plans("SELECT item_id || '#0' AS query_id, item_id AS of, 0 AS variant, text FROM benchmark")
def q01_expand_passthrough(spark, d):
    return Q.expand_passthrough(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question")))


@plans("""SELECT item_id || '#' || variant AS query_id, item_id AS of, variant, text FROM (SELECT b.item_id, 0 AS variant, b.text FROM benchmark b UNION ALL SELECT b.item_id, 1, d.text FROM benchmark b JOIN documents d ON d.doc_id = b.item_id WHERE regexp_matches(d.text, '\\S'))""")
def q03_expand_hypothetical(spark, d):
    """The document of the same number stands for one that a model wrote."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    made = table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("made"))
    return Q.expand_hypothetical(b.join(made, "query_id", "left"), "made")


@plans("""SELECT doc_id AS page_no, 'p_' || lpad(doc_id::VARCHAR, greatest(4, length(doc_id::VARCHAR))::INT, '0') AS doc_id, md5(trim(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\n\\s*\\n+', chr(10), 'g'), ' ')) AS digest FROM documents WHERE regexp_matches(text, '\\S')""".replace("\\\\", "\\"))
def s06_read_pages(spark, d):
    p = S.read_pages(table(spark, d, "documents"), "doc_id")
    return p.select("page_no", "doc_id", F.md5("text").alias("digest"))


@plans("SELECT item_id::VARCHAR AS key, sha256(text) AS value FROM benchmark")
def s11_cached_apply(spark, d):
    """Digests of the benchmark's texts; half of them are cached already."""
    b = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("key"), "text")
    make = lambda df: df.withColumn("value", F.sha2("text", 256))
    _, half = S.cached_apply(b.where("cast(key AS int) % 2 = 0"), spark.sql("SELECT '' AS hash, '' AS value WHERE false"), ["text"], make, "value")
    return S.cached_apply(b, half, ["text"], make, "value")[0].select("key", "value")


# --- vocabulary: names of parts as raw lines -------------------------------------------------------
def vocabulary(spark, d):
    """Second words as families of which each name is an alias of its first; "hot" names are split, "red ring" is rejected."""
    p = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    family = p.where("name NOT LIKE 'hot %' AND name != 'red ring'").groupBy(F.split("name", " ")[1].alias("category")).agg(F.min("name").alias("canonical"), F.array_sort(F.collect_list("name")).alias("aliases"))
    splits = p.where("name LIKE 'hot %'").select("name", F.split("name", " ").alias("parts"))
    return V.build_vocabulary(V.name_frequencies(table(spark, d, "part"), "p_name"), V.build_dictionary(family, splits, p.where("name = 'red ring'")))


NORM = "norm AS (SELECT p_partkey, p_name, trim(regexp_replace(regexp_replace(p_name, '\\b(?:" + V.QUALIFIER + "|" + V.PREPARATION + ")\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS name FROM part)"


@plans(f"WITH {NORM} SELECT p_partkey, CASE WHEN length(name) >= 3 THEN name END AS name FROM norm")
def v01_normalise_lines(spark, d):
    return V.normalise_lines(table(spark, d, "part").select("p_partkey", "p_name"), "p_name").select("p_partkey", "name")


@plans("SELECT DISTINCT p_name AS name, list_has_any(string_split(p_name, ' '), ['" + "', '".join(V.IDENTITY_BEARING) + "']) AS bearing FROM part")
def v02_identity_bearing(spark, d):
    return table(spark, d, "part").select(F.col("p_name").alias("name"), V.identity_bearing(F.col("p_name")).alias("bearing")).distinct()


@plans(f"WITH {NORM} SELECT name, count(*) AS n FROM norm WHERE length(name) >= 3 GROUP BY name")
def v03_name_frequencies(spark, d):
    return V.name_frequencies(table(spark, d, "part"), "p_name")


VOC = f"""WITH {NORM}, p AS (SELECT DISTINCT p_name AS name FROM part), fam AS (SELECT string_split(name, ' ')[2] AS category, min(name) AS canonical FROM p WHERE name NOT LIKE 'hot %' AND name != 'red ring' GROUP BY 1),
dict AS (SELECT name, canonical, category, NULL::VARCHAR[] AS split FROM p JOIN fam ON category = string_split(name, ' ')[2] WHERE name NOT LIKE 'hot %' AND name != 'red ring' UNION ALL SELECT name, name, 'none', string_split(name, ' ') FROM p WHERE name LIKE 'hot %' UNION ALL SELECT name, NULL, NULL, NULL FROM p WHERE name = 'red ring'),
freq AS (SELECT name, count(*) AS n FROM norm WHERE length(name) >= 3 GROUP BY name),
voc AS (SELECT coalesce(d.name, f.name) AS name, coalesce(n, 0) AS n, CASE WHEN d.name IS NULL THEN f.name ELSE canonical END AS canonical, CASE WHEN d.name IS NULL THEN 'none' ELSE category END AS category, split, d.name IS NOT NULL AS decided FROM freq f FULL JOIN dict d ON d.name = f.name)"""


@plans(VOC + " SELECT name, n, canonical, category, split, decided FROM voc")
def v05_build_vocabulary(spark, d):
    return vocabulary(spark, d)


@plans(VOC + """ SELECT 'corpus_names' AS measure, count(*) FILTER (n > 0) AS value FROM voc UNION ALL SELECT 'decided', count(*) FILTER (decided AND n > 0) FROM voc UNION ALL SELECT 'undecided', count(*) FILTER (NOT decided) FROM voc UNION ALL SELECT 'entries', count(*) FROM voc
UNION ALL SELECT 'rejected', count(*) FILTER (canonical IS NULL AND split IS NULL) FROM voc UNION ALL SELECT 'splits', count(*) FILTER (split IS NOT NULL) FROM voc
UNION ALL SELECT 'canonical_names', count(DISTINCT c) FROM (SELECT canonical AS c FROM voc WHERE split IS NULL AND canonical IS NOT NULL UNION ALL SELECT unnest(split) FROM voc WHERE split IS NOT NULL)
UNION ALL SELECT 'orphan_parts', count(DISTINCT c) FROM (SELECT unnest(split) AS c FROM voc WHERE split IS NOT NULL) WHERE c NOT IN (SELECT canonical FROM voc WHERE split IS NULL AND canonical IS NOT NULL)
UNION ALL SELECT 'category:' || category, count(DISTINCT canonical) FROM voc WHERE canonical IS NOT NULL AND split IS NULL GROUP BY category""")
def v06_vocabulary_stats(spark, d):
    return V.vocabulary_stats(vocabulary(spark, d))


@plans(VOC + """, r AS (SELECT p_partkey, norm.name, voc.name IS NULL AS unseen, canonical, split FROM norm LEFT JOIN voc ON voc.name = norm.name WHERE length(norm.name) >= 3)
SELECT p_partkey, unnest(CASE WHEN unseen THEN [name] WHEN split IS NOT NULL THEN split WHEN canonical IS NOT NULL THEN [canonical] ELSE [] END) AS item FROM r""")
def v07_resolve(spark, d):
    return V.resolve(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", vocabulary(spark, d)).select("p_partkey", "item")


@plans(VOC + """, k AS (SELECT name AS k, category, 0 AS r FROM voc WHERE split IS NULL AND category != 'none' UNION ALL SELECT canonical, category, 1 FROM voc WHERE split IS NULL AND category != 'none'),
b AS (SELECT k, category FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY r, category) AS at_ FROM k) WHERE at_ = 1) SELECT DISTINCT p_name AS item, coalesce(category, 'none') AS category FROM part LEFT JOIN b ON k = p_name""")
def v08_category_of(spark, d):
    return V.category_of(table(spark, d, "part").select(F.col("p_name").alias("item")).distinct(), vocabulary(spark, d))


@plans(VOC + " SELECT canonical FROM voc WHERE split IS NULL AND canonical IS NOT NULL UNION SELECT unnest(split) FROM voc WHERE split IS NOT NULL")
def v09_canonical_names(spark, d):
    return V.canonical_names(vocabulary(spark, d))


# --- questions and conversations ------------------------------------------------------------------
def benchmark_questions(spark, d):
    """Questions of the templates, about words of the benchmark's texts."""
    b = table(spark, d, "benchmark").select("item_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w"))
    texts = F.array(F.concat(F.lit("A "), F.col("w")[0], F.lit(" dish with no egg in it.")), F.concat(F.lit("What can I use instead of "), F.col("w")[1], F.lit("?")), F.concat(F.lit("I only have "), F.col("item_id").cast("string"), F.lit(" minutes")), F.concat(F.lit("How is "), F.col("w")[2], F.lit(" made?")))
    return b.select(F.explode(F.transform(texts, lambda t, i: F.struct((F.col("item_id") * 4 + i).alias("query_id"), t.alias("question")))).alias("q")).select("q.*")


@plans("""WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark), q AS (SELECT item_id * 4 AS of_, ['A ' || w[1] || ' dish with no egg in it.', w[1] || ' recipe', 'egg eggs'] AS t FROM b UNION ALL
SELECT item_id * 4 + 1, ['What can I use instead of ' || w[2] || '?', 'recipes using ' || w[2], 'substitute for ' || w[2]] FROM b UNION ALL SELECT item_id * 4 + 2, ['I only have ' || item_id || ' minutes', 'quick recipe short cooking time', item_id || ' minutes'] FROM b UNION ALL SELECT item_id * 4 + 3, ['How is ' || w[3] || ' made?'] FROM b)
SELECT of_ AS "of", unnest(range(0, len(t))) AS variant, unnest(t) AS text FROM q""")
def q02_expand_decompose(spark, d):
    return Q.expand_decompose(benchmark_questions(spark, d)).select("of", F.col("variant").cast("long").alias("variant"), "text")


@plans("SELECT doc_id, ['text ' || left(text, 5)] AS include, CASE WHEN lang = 'en' THEN ['x'] ELSE [] END AS exclude, CASE WHEN lang = 'en' THEN ['dairy', 'egg'] ELSE ['dairy'] END AS exclude_categories FROM (SELECT doc_id, lang, lower(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS text FROM documents) WHERE text != ''")
def q04_parse_constraints(spark, d):
    """Replies written from the documents: a family among the excluded names, and a replacement."""
    t = table(spark, d, "documents").select("doc_id", "lang", F.lower(F.regexp_replace("text", "[^A-Za-z]", "")).alias("t")).where("t != ''")
    reply = F.concat(F.lit('Sure: {"include": [" Text '), F.substring("t", 1, 5), F.lit('", "egg"], "exclude": ['), F.when(F.col("lang") == "en", '"X", "egg", "ghee"').otherwise('"ghee"'), F.lit('], "exclude_categories": ["dairy", "stone"], "substitute_for": "Ghee", "course": "lunch"} ok'))
    return Q.parse_constraints(t.select("doc_id", reply.alias("reply"))).select("doc_id", "include", "exclude", "exclude_categories")


@plans("SELECT conv_id, left(arg_min(text, turn) FILTER (role = 'user'), 58) AS title, count(*) AS n_turns, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def q06_conversation_summary(spark, d):
    return Q.conversation_summary(table(spark, d, "conversations"))


@plans("""WITH t AS (SELECT *, list(CASE WHEN role = 'user' THEN 'You: ' ELSE 'Assistant: ' END || left(coalesce(text, ''), 300)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS h FROM conversations)
SELECT conv_id, turn, coalesce(array_to_string(h, chr(10)), '') AS history FROM t WHERE role = 'user'""")
def q07_transcript(spark, d):
    return Q.transcript(table(spark, d, "conversations")).select("conv_id", "turn", "history")


SUBJECT = """names AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS canonical FROM benchmark), q AS (SELECT conv_id, turn, text, regexp_extract_all(lower(text), '[a-z]+') AS w FROM conversations WHERE role = 'user'),
s AS (SELECT q.*, EXISTS (SELECT 1 FROM (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS p) JOIN names ON canonical = p WHERE length(p) > 3) AS has_subject FROM q)"""


def _turns(spark, d):
    names = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("canonical")).distinct()
    t = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    return Q.has_subject(t, names, ["conv_id", "turn"])


@plans(f"WITH {SUBJECT} SELECT conv_id, turn, has_subject FROM s")
def q08_has_subject(spark, d):
    return _turns(spark, d).select("conv_id", "turn", "has_subject")


@plans(rf"WITH {SUBJECT} SELECT conv_id, turn, CASE WHEN regexp_matches(text, '{Q.FOLLOW_UP}') THEN NOT has_subject OR n <= 5 ELSE n <= 4 AND NOT has_subject END AS follow_up FROM (SELECT *, len(regexp_extract_all(text, '\S+')) AS n FROM s)")
def q09_is_follow_up(spark, d):
    return Q.is_follow_up(_turns(spark, d)).select("conv_id", "turn", "follow_up")


@plans(rf"""WITH {SUBJECT}, f AS (SELECT *, CASE WHEN regexp_matches(text, '{Q.FOLLOW_UP}') THEN NOT has_subject OR n <= 5 ELSE n <= 4 AND NOT has_subject END AS follow_up FROM (SELECT *, len(regexp_extract_all(text, '\S+')) AS n FROM s))
SELECT conv_id, turn, follow_up AND turn > (SELECT min(turn) FROM conversations c WHERE c.conv_id = f.conv_id) AS rewritten FROM f""")
def q10_resolve_follow_ups(spark, d):
    q = Q.is_follow_up(_turns(spark, d)).join(Q.transcript(table(spark, d, "conversations")).select("conv_id", "turn", "history"), ["conv_id", "turn"])
    replies = q.select("conv_id", "turn", F.concat(F.lit('"about '), F.substring("question", 1, 50), F.lit('"')).alias("reply"))
    return Q.resolve_follow_ups(q, replies, ["conv_id", "turn"]).select("conv_id", "turn", "rewritten")


# --- contexts: turns of a conversation as its ranked passages ----------------------------------------
def _hits(spark, d):
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("passage_id"), (F.col("turn") + 1).alias("rank"), F.coalesce("text", F.lit("")).alias("text"))
    return t, t.select("query_id").distinct().withColumn("question", F.concat(F.lit("q"), F.col("query_id").cast("string")))


@plans("SELECT conv_id AS query_id, md5(string_agg(coalesce(text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def a01_contexts_stuffed(spark, d):
    return A.contexts_stuffed(*_hits(spark, d)).select("query_id", F.md5("context").alias("digest"))


@plans("SELECT conv_id AS query_id, list(turn ORDER BY CASE WHEN turn % 2 = 0 THEN turn ELSE 1000000 - turn END) AS passages FROM conversations GROUP BY conv_id")
def a02_contexts_reordered(spark, d):
    return A.contexts_reordered(*_hits(spark, d)).select("query_id", "passages")


@plans("SELECT conv_id AS query_id, count(*) FILTER (role = 'assistant') AS n_notes, count(*) FILTER (role = 'assistant') = 0 AS refused FROM conversations GROUP BY conv_id")
def a04_reduce_prompts(spark, d):
    h, q = _hits(spark, d)
    notes = table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.when(F.col("role") == "assistant", F.lit("note")).otherwise(A.REFUSAL).alias("note"))
    out = A.reduce_prompts(notes, q)
    return out.select("query_id", F.coalesce(F.size(F.split("prompt", "- note")) - 1, F.lit(0)).cast("long").alias("n_notes"), "refused")


@plans("SELECT conv_id AS query_id, 'conv:' || role AS key, min(turn) + 1 AS rank FROM conversations GROUP BY conv_id, role")
def a06_citations(spark, d):
    t = table(spark, d, "conversations")
    c = t.select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).alias("rank"), F.lit("conv").alias("source"), F.array("role").alias("doc_ids"), "text")
    return A.citations(c).select("query_id", "key", "rank")
