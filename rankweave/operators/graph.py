"""Node and edge tables of records and items, and set questions answered by joins over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankweave.functions.numbering import numbered
from rankweave.functions.saved import saved
from rankweave.operators.blocks import BROADCAST_ENTRIES
from rankweave.operators.extract import ACTIONS, EQUIPMENT, extract_terms
from rankweave.operators.sets import by_rarity, lacking_at_most
from rankweave.operators.vocab import category_of, resolve

MIN_ITEMS = 2
# Courses.
COURSES = ("bread", "rice", "main", "side", "condiment", "snack", "dessert", "drink", "soup", "salad", "breakfast", "spice-mix", "other")
# End of fixed values.


def record_key() -> Column:
    return F.concat_ws(":", "source", "record_id").alias("key")


# --- shapes ---------------------------------------------------------------------------------------
def _full(records: DataFrame) -> DataFrame:
    return records.where("coalesce(size(ingredient_lines), 0) > 0 OR coalesce(size(step_lines), 0) > 0")


def shape_uses(records: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Distinct (key, item, raw)."""
    lines = _full(records).select(record_key(), F.explode("ingredient_lines").alias("raw"))
    return resolve(lines, "raw", vocabulary).select("key", "item", "raw").distinct()


def shape_recipes(records: DataFrame, uses: DataFrame) -> DataFrame:
    """(key, title, pages, n_items, n_steps, is_recipe); records with neither items nor steps are left out."""
    n = uses.groupBy("key").agg(F.count_distinct("item").alias("n_items"))
    r = _full(records).select(record_key(), "title", "pages", F.greatest(F.size("step_lines"), F.lit(0)).alias("n_steps"))
    r = r.join(n, "key", "left").withColumn("n_items", F.coalesce("n_items", F.lit(0)))
    return r.withColumn("is_recipe", F.col("n_items") >= MIN_ITEMS)


def shape_ingredients(uses: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Distinct (item, category)."""
    return category_of(uses.select("item").distinct(), vocabulary)


def shape_categories(ingredients: DataFrame) -> DataFrame:
    return ingredients.where("category != 'none'").select("category").distinct().orderBy("category")


def shape_steps(records: DataFrame) -> DataFrame:
    """(key, step_id, step_no from 0, text)."""
    s = _full(records).select(record_key(), F.posexplode("step_lines").alias("step_no", "text"))
    return s.select("key", F.format_string("%s#s%02d", "key", "step_no").alias("step_id"), "step_no", "text")


def shape_performs(steps: DataFrame) -> DataFrame:
    return steps.select("step_id", F.explode(extract_terms(F.col("text"), ACTIONS)).alias("action"))


def shape_needs(steps: DataFrame) -> DataFrame:
    return steps.select("step_id", F.explode(extract_terms(F.col("text"), EQUIPMENT)).alias("equipment"))


def shape_next(steps: DataFrame) -> DataFrame:
    """(step_id, next_id) of consecutive steps of a record."""
    following = F.lead("step_id").over(Window.partitionBy("key").orderBy("step_no"))
    return steps.select("step_id", following.alias("next_id")).where("next_id IS NOT NULL")


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, after failing if two rows share the keys."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{keys} repeat: {twice[0]}")
    return df


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], order_by: str | None = None, endpoints: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """table with rows merged by key: the new row wins, among new ones the last by order_by.

    endpoints maps a column of an edge to (nodes, column); edges with a missing end match nothing.
    """
    for column, (nodes, node_column) in (endpoints or {}).items():
        rows = rows.join(nodes.select(F.col(node_column).alias(column)).distinct(), column, "left_semi")
    both = table.withColumn("_new", F.lit(0)).unionByName(rows.select(*table.columns).withColumn("_new", F.lit(1)))
    rest = [F.desc(c) for c in ([order_by] if order_by else []) + [c for c in table.columns if c not in keys and c != order_by]]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_new"), *rest))
    return both.withColumn("_at", first).where("_at = 1").drop("_new", "_at")


def graph_report(recipes: DataFrame, ingredients: DataFrame, steps: DataFrame, uses: DataFrame, next_steps: DataFrame, performs: DataFrame, needs: DataFrame) -> DataFrame:
    """(label, n) for each kind of node and edge; pages that are no real record are "skipped"."""
    count = lambda df, label: df.agg(F.count("*").alias("n")).select(F.lit(label).alias("label"), "n")
    parts = [
        count(recipes, "Recipe"), count(recipes.where("is_recipe"), "Recipe(real)"), count(recipes.where("NOT is_recipe"), "skipped"), count(ingredients, "Ingredient"), count(shape_categories(ingredients), "Category"),
        count(steps, "Step"), count(uses.select("key", "item").distinct(), "USES"), count(next_steps, "NEXT"), count(performs, "PERFORMS"), count(needs, "NEEDS"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def course_prompts(recipes: DataFrame, uses: DataFrame, known: DataFrame, batch: int = 25) -> DataFrame:
    """(batch_no, prompt, keys) for the records whose course is not known yet: titles and their first ten items."""
    items = uses.groupBy("key").agg(F.array_join(F.slice(F.array_sort(F.collect_set("item")), 1, 10), ", ").alias("items"))
    r = recipes.join(known.select("key").distinct(), "key", "left_anti").join(items, "key", "left")
    of = F.substring_index("key", ":", 1)
    placed = numbered(r.withColumn("of", of), "of", "key", number="place")  # no task has a whole source
    first = placed.groupBy("of").agg(F.min("place").alias("first"))
    r = placed.join(first, "of").withColumn("place", F.col("place") - F.col("first"))
    r = r.withColumn("batch_no", F.concat_ws("#", "of", F.floor(F.col("place") / batch).cast("string"))).withColumn("n", (F.col("place") % batch + 1).cast("int"))
    line = F.concat(F.col("n").cast("string"), F.lit(". "), F.substring(F.coalesce("title", F.lit("")), 1, 70), F.lit(" | "), F.coalesce("items", F.lit("")))
    g = r.groupBy("batch_no").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line"), "key"))).alias("rows"))
    return g.select("batch_no", F.array_join("rows.line", "\n").alias("prompt"), F.col("rows.key").alias("keys"))


def assign_course(prompts: DataFrame, replies: DataFrame, known: DataFrame, courses: tuple[str, ...] = COURSES) -> DataFrame:
    """known(key, course) with the courses read from replies(batch_no, reply), lines {"n", "course"}; what is missing or not allowed is "other"."""
    said = replies.select("batch_no", F.explode(F.regexp_extract_all("reply", F.lit(r"\{[^{}]*\}"), F.lit(0))).alias("j")).select("batch_no", F.from_json("j", "n INT, course STRING").alias("j"))
    said = said.select("batch_no", F.col("j.n").alias("n"), F.lower(F.trim("j.course")).alias("course")).where(F.col("course").isin(*courses)).groupBy("batch_no", "n").agg(F.min("course").alias("course"))
    rows = prompts.select("batch_no", F.posexplode("keys").alias("at", "key")).withColumn("n", F.col("at") + 1)
    new = rows.join(said, ["batch_no", "n"], "left").select("key", F.coalesce("course", F.lit("other")).alias("course"))
    return known.select("key", "course").unionByName(new)


# --- membership -----------------------------------------------------------------------------------
def all_real(recipes: DataFrame) -> DataFrame:
    return recipes.where("is_recipe")


def of_course(recipes: DataFrame, course: str) -> DataFrame:
    return all_real(recipes).where(F.col("course") == course)


def using_all(recipes: DataFrame, uses: DataFrame, names: list[str]) -> DataFrame:
    """Real records that use every name."""
    wanted = set(names)
    hit = uses.where(F.col("item").isin(*wanted)).groupBy("key").agg(F.count_distinct("item").alias("n")).where(F.col("n") == len(wanted))
    return all_real(recipes).join(hit.select("key"), "key", "left_semi")


def using_any(recipes: DataFrame, uses: DataFrame, names: list[str]) -> DataFrame:
    return all_real(recipes).join(uses.where(F.col("item").isin(*names)), "key", "left_semi")


def without_items(recipes: DataFrame, uses: DataFrame, names: list[str]) -> DataFrame:
    """Real records that use none; without names, all."""
    return all_real(recipes).join(uses.where(F.col("item").isin(*names)), "key", "left_anti") if names else all_real(recipes)


def without_categories(recipes: DataFrame, uses: DataFrame, ingredients: DataFrame, categories: list[str]) -> DataFrame:
    """Real records without an item of the families; "none" and blanks are ignored."""
    banned = [c for c in categories if c and c != "none"]
    if not banned:
        return all_real(recipes)
    items = ingredients.where(F.col("category").isin(*banned)).select("item")
    return all_real(recipes).join(uses.join(items, "item", "left_semi"), "key", "left_anti")


def packed(recipes: DataFrame, uses: DataFrame) -> DataFrame:
    """(key, course, items) of real records, a row for each; course may be null."""
    real = all_real(recipes).select("key", "course" if "course" in recipes.columns else F.lit(None).cast("string").alias("course"))
    return real.join(uses.groupBy("key").agg(F.collect_set("item").alias("items")), "key", "left")


def filter_recipes(questions: DataFrame, recipes: DataFrame, uses: DataFrame, ingredients: DataFrame, include_mode: str = "any") -> DataFrame:
    """(query_id, key) for a batch of questions(query_id, course, include, exclude, exclude_categories), all optional but the id; filter_sets() over packed()."""
    return filter_sets(questions, packed(recipes, uses), ingredients, include_mode)


def filter_sets(questions: DataFrame, records: DataFrame, ingredients: DataFrame, include_mode: str = "any") -> DataFrame:
    """(query_id, key) of records(key, course, items), one row for each with all its different items.

    Names are canonical; one that is no item of the graph is unresolvable. If a question includes
    names and none resolves, it has no records; an unresolvable exclusion is none; a question
    without conditions has all records. A record is judged where it lies, if the questions with what they exclude
    fit BROADCAST_ENTRIES; else it meets them by item. A job runs at once.
    """
    none = F.array().cast("array<string>")
    q = questions.select("query_id", F.coalesce("course", F.lit("")).alias("course"), *(F.coalesce(c, none).alias(c) for c in ("include", "exclude", "exclude_categories")))
    wanted = q.select("query_id", F.explode(F.array_distinct("include")).alias("item")).join(ingredients.select("item").distinct(), "item", "left_semi")
    families = q.select("query_id", F.explode("exclude_categories").alias("category")).where("category NOT IN ('', 'none')").distinct()
    banned = q.select("query_id", F.explode("exclude").alias("item")).unionByName(families.join(ingredients.select("item", "category").distinct(), "category").select("query_id", "item"))
    asked = q.select("query_id", "course", (F.size("include") == 0).alias("open"))
    for rows, name in ((wanted, "wanted"), (banned, "banned")):
        asked = asked.join(rows.groupBy("query_id").agg(F.collect_set("item").alias(name)), "query_id", "left").withColumn(name, F.coalesce(name, none))
    asked = saved(asked)
    entries = asked.agg(F.sum(1 + F.size("banned") + F.size("wanted") * F.size("wanted"))).first()[0] or 0
    near = F.broadcast if entries <= BROADCAST_ENTRIES else lambda x: x

    r = records.select("key", F.col("course").alias("of"), F.coalesce("items", none).alias("items"))
    each = r.select("key", "of", "items", F.explode("items").alias("item"))
    held = asked.where("NOT open")
    if include_mode == "any":  # a record that has several names is met by the first of them
        held = held.withColumn("item", F.explode("wanted"))
        fits = F.when(F.size("wanted") == 1, True).otherwise(F.array_intersect("wanted", "items")[0] == each["item"])
    else:
        first = by_rarity(wanted, "query_id", each.select("item")).where("place = 1").select("query_id", "item")
        held = held.join(first, "query_id")
        fits = F.size(F.array_except("wanted", "items")) == 0
    free = ~F.coalesce(F.arrays_overlap("items", "banned"), F.lit(False))
    hits = each.join(near(held), (each["item"] == held["item"]) & ((F.col("course") == "") | (F.col("course") == F.col("of"))) & fits & free)
    of_any = r.join(near(asked.where("open AND course = ''")), free)  # the answer to no condition
    of_course = r.join(near(asked.where("open AND course != ''")), (F.col("course") == F.col("of")) & free)
    return hits.select("query_id", "key").unionByName(of_any.select("query_id", "key")).unionByName(of_course.select("query_id", "key"))


def pantry_gap(pantries: DataFrame, recipes: DataFrame, uses: DataFrame, max_missing: int = 3, limit: int = 20) -> DataFrame:
    """pantries(pantry_id, item) -> (pantry_id, key, n_needed, n_missing, missing, place): records that lack at most max_missing items, best first."""
    edges = saved(uses.select("key", "item").distinct().join(all_real(recipes).select("key"), "key", "left_semi"))
    own = saved(pantries.select("pantry_id", "item").distinct())
    c = lacking_at_most(own, edges, max_missing, limit)
    order = Window.partitionBy("pantry_id").orderBy("n_missing", F.desc("n_needed"), "key")
    top = saved(c.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit))
    gap = edges.join(top.select("pantry_id", "key"), "key").join(own, ["pantry_id", "item"], "left_anti").groupBy("pantry_id", "key").agg(F.array_sort(F.collect_set("item")).alias("missing"))
    return top.join(gap, ["pantry_id", "key"], "left").withColumn("missing", F.coalesce("missing", F.array().cast("array<string>")))


def substitutes(targets: DataFrame, recipes: DataFrame, uses: DataFrame, ingredients: DataFrame, limit: int = 8, min_shared: int = 3) -> DataFrame:
    """targets(item) -> (item, other, shared, together, score, place): items of its family with like company that rarely join it.

    score = |contexts in common| / |contexts of either| * (1 - records with both / records with the
    item). Everything starts from the targets: their companions, and those companions' companions.
    """
    edges = uses.select("key", "item").distinct().join(all_real(recipes).select("key"), "key", "left_semi")
    family = ingredients.select("item", "category")
    t = targets.select("item").distinct().join(family, "item")
    others = t.join(family.select(F.col("item").alias("other"), "category"), "category").where("item != other").select("item", "other")
    pairs = lambda items: items.join(edges, "item").select("item", "key").join(edges.select("key", F.col("item").alias("ctx")), "key").where("item != ctx").select("item", "ctx").distinct()
    relevant = t.select("item").unionByName(others.select(F.col("other").alias("item"))).distinct()
    ctx = pairs(relevant)
    size = ctx.groupBy("item").agg(F.count("*").alias("n_ctx"))
    shared = t.select("item").join(ctx, "item").join(ctx.select(F.col("item").alias("other"), "ctx"), "ctx").where("item != other")
    shared = shared.join(others, ["item", "other"], "left_semi").groupBy("item", "other").agg(F.count("*").alias("shared")).where(F.col("shared") >= min_shared)
    n_rec = edges.join(t.select("item"), "item", "left_semi").groupBy("item").agg(F.count("*").alias("n_rec"))
    both = t.select("item").join(edges, "item").join(edges.select("key", F.col("item").alias("other")), "key").where("item != other").groupBy("item", "other").agg(F.count("*").alias("together"))
    s = shared.join(size, "item").join(size.select(F.col("item").alias("other"), F.col("n_ctx").alias("n_other")), "other").join(n_rec, "item").join(both, ["item", "other"], "left")
    s = s.withColumn("together", F.coalesce("together", F.lit(0)))
    score = F.round(F.col("shared") / (F.col("n_ctx") + F.col("n_other") - F.col("shared")) * (1 - F.col("together") / F.col("n_rec")), 3)
    s = s.withColumn("score", score)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "other")
    return s.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("item", "other", "shared", "together", "score", "place")


# --- details --------------------------------------------------------------------------------------
def steps_for(keys: DataFrame, steps: DataFrame, performs: DataFrame, needs: DataFrame) -> DataFrame:
    """Steps of keys(key) in order, with their sorted actions and equipment."""
    s = steps.join(keys.select("key").distinct(), "key", "left_semi")
    a = performs.groupBy("step_id").agg(F.array_sort(F.collect_set("action")).alias("actions"))
    e = needs.groupBy("step_id").agg(F.array_sort(F.collect_set("equipment")).alias("equipment"))
    none = F.array().cast("array<string>")
    out = s.join(a, "step_id", "left").join(e, "step_id", "left")
    return out.select("key", "step_id", "step_no", "text", F.coalesce("actions", none).alias("actions"), F.coalesce("equipment", none).alias("equipment")).orderBy("key", "step_no")


def needing_equipment(recipes: DataFrame, steps: DataFrame, needs: DataFrame, name: str) -> DataFrame:
    owners = steps.join(needs.where(F.col("equipment") == name), "step_id", "left_semi").select("key")
    return all_real(recipes).join(owners, "key", "left_semi")


def recipe_cards(keys: DataFrame, recipes: DataFrame, uses: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, title, pages, text, items) of keys(key); texts(key, text) may lack some."""
    items = uses.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    cards = keys.select("key").distinct().join(recipes.select("key", "title", "pages"), "key").join(texts.select("key", "text"), "key", "left").join(items, "key", "left")
    return cards.withColumn("items", F.coalesce("items", F.array().cast("array<string>"))).withColumn("text", F.coalesce("text", F.concat_ws("\n", "title", F.array_join("items", "\n"))))


def graph_stats(recipes: DataFrame, uses: DataFrame, ingredients: DataFrame, steps: DataFrame | None = None, needs: DataFrame | None = None) -> DataFrame:
    """(measure, name, n): real records, records and items of each family, records free of each family, records for each piece of equipment."""
    real = all_real(recipes).select("key")
    edges = uses.select("key", "item").distinct().join(real, "key", "left_semi").join(ingredients, "item")
    total = real.agg(F.count("*").alias("n"))
    by = edges.groupBy("category").agg(F.count_distinct("key").alias("records"), F.count_distinct("item").alias("items"))
    rows = by.select(F.explode(F.array(F.struct(F.lit("records").alias("measure"), F.col("category").alias("name"), F.col("records").alias("n")), F.struct(F.lit("items").alias("measure"), F.col("category").alias("name"), F.col("items").alias("n")))).alias("r")).select("r.*")
    free = by.where("category != 'none'").join(F.broadcast(total)).select(F.lit("free_of").alias("measure"), F.col("category").alias("name"), (F.col("n") - F.col("records")).alias("n"))
    out = total.select(F.lit("real").alias("measure"), F.lit("").alias("name"), "n").unionByName(rows).unionByName(free)
    if steps is not None and needs is not None:
        eq = needs.join(steps.select("step_id", "key"), "step_id").join(real, "key", "left_semi").groupBy("equipment").agg(F.count_distinct("key").alias("n"))
        out = out.unionByName(eq.select(F.lit("equipment").alias("measure"), F.col("equipment").alias("name"), "n"))
    return out


def resolve_pantry(lines: DataFrame, vocabulary: DataFrame, ingredients: DataFrame, guesses: DataFrame | None = None) -> DataFrame:
    """lines(pantry_id, line) -> (pantry_id, known, unknown): names that the graph has, by the vocabulary or by guesses(line, guess), and the lines left over."""
    graph = ingredients.select("item").distinct()
    found = resolve(lines, "line", vocabulary).join(graph, "item", "left_semi").select("pantry_id", "line", "item")
    left = lines.join(found.select("pantry_id", "line").distinct(), ["pantry_id", "line"], "left_anti")
    if guesses is not None:
        guessed = left.join(guesses.select("line", F.col("guess").alias("item")), "line").join(graph, "item", "left_semi").select("pantry_id", "line", "item")
        left = left.join(guessed.select("pantry_id", "line").distinct(), ["pantry_id", "line"], "left_anti")
        found = found.unionByName(guessed)
    known = found.groupBy("pantry_id").agg(F.array_sort(F.collect_set("item")).alias("known"))
    rest = left.groupBy("pantry_id").agg(F.array_sort(F.collect_set("line")).alias("unknown"))
    none = F.array().cast("array<string>")
    return lines.select("pantry_id").distinct().join(known, "pantry_id", "left").join(rest, "pantry_id", "left").select("pantry_id", F.coalesce("known", none).alias("known"), F.coalesce("unknown", none).alias("unknown"))


def can_i_make(pairs: DataFrame, pantries: DataFrame, uses: DataFrame, swaps: DataFrame, max_swaps: int = 6) -> DataFrame:
    """pairs(pantry_id, key), pantries(pantry_id, item), swaps(item, other, place) -> what is had, swapped and bought.

    The first max_swaps missing items by name try their substitutes, best first, that the pantry
    has; the rest are bought. can_make: something is needed and nothing bought.
    """
    own = pantries.select("pantry_id", "item").distinct()
    need = pairs.select("pantry_id", "key").distinct().join(uses.select("key", "item").distinct(), "key")
    missing = need.join(own, ["pantry_id", "item"], "left_anti").withColumn("at", F.row_number().over(Window.partitionBy("pantry_id", "key").orderBy("item")))
    tried = missing.where(F.col("at") <= max_swaps).join(swaps.select("item", "other", "place"), "item").join(own.select("pantry_id", F.col("item").alias("other")), ["pantry_id", "other"])
    best = tried.groupBy("pantry_id", "key", "item").agg(F.min_by("other", F.struct("place", "other")).alias("other"))
    m = missing.join(best, ["pantry_id", "key", "item"], "left")
    lists = m.groupBy("pantry_id", "key").agg(
        F.array_sort(F.collect_list(F.struct("item", "other"))).alias("all"), F.array_sort(F.collect_list(F.when(F.col("other").isNull(), F.col("item")))).alias("buy"),
    )
    had = need.join(own, ["pantry_id", "item"], "left_semi").groupBy("pantry_id", "key").agg(F.array_sort(F.collect_list("item")).alias("have"))
    count = need.groupBy("pantry_id", "key").agg(F.count("*").alias("n_needed"))
    none = F.array().cast("array<string>")
    out = pairs.select("pantry_id", "key").distinct().join(count, ["pantry_id", "key"], "left").join(had, ["pantry_id", "key"], "left").join(lists, ["pantry_id", "key"], "left")
    swapped = F.map_from_entries(F.filter(F.coalesce("all", F.array().cast("array<struct<item:string,other:string>>")), lambda x: x["other"].isNotNull()))
    n = F.coalesce("n_needed", F.lit(0))
    return out.select("pantry_id", "key", n.alias("n_needed"), F.coalesce("have", none).alias("have"), swapped.alias("swaps"), F.coalesce("buy", none).alias("buy"), ((n > 0) & (F.size(F.coalesce("buy", none)) == 0)).alias("can_make"))
