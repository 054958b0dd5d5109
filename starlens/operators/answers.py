"""Batch answering of a table of questions.  (J1)"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starlens.config import RETAIL, StarConfig
from starlens.functions.questions import (
    classify,
    deployed_route,
    is_pattern,
    month_of,
    product_mentions,
    quarter_of,
    year_of,
)
from starlens.functions.render import buyer_line, date_phrase, semantic_answers, semantic_lines
from starlens.functions.vectors import TermModel, embed_queries
from starlens.joins import SALTS, dealt, lookup_join
from starlens.operators.search import batch_semantic_search
from starlens.session import cut_lineage

AGGREGATION_NOTE = (
    "This looks like an aggregation question; run it as a star aggregation for exact figures.\n"
    "Falling back to semantic search.\n"
)
NO_MENTION = "No product could be read from the question; quote its name or give its id."


def resolve_mentions(mentions: DataFrame, items: DataFrame, key: str = "item_id", label: str = "item_name") -> DataFrame:
    """First item (smallest id) whose id equals or whose name contains each mention, in any case.

    Containment is an equality on substrings: each distinct name is cut into its substrings of the
    lengths that mentions have, so mentions meet names through a hash join and never pair by pair.
    """
    wanted = mentions.select(F.lower("mention").alias("m")).distinct()
    lengths = wanted.agg(F.sort_array(F.collect_set(F.length("m"))).alias("n")).scalar()
    names = items.groupBy(F.lower(label).alias("name")).agg(F.min(key).alias("first_item"))
    cut = F.flatten(
        F.transform(
            F.filter("n", lambda n: n <= F.length("name")),
            lambda n: F.transform(
                F.sequence(F.lit(1), F.length("name") - n + 1), lambda i: F.substr(F.col("name"), i, n)
            ),
        )
    )
    pieces = names.withColumn("n", lengths).select(F.explode(F.array_distinct(cut)).alias("m"), "first_item")
    ids = items.select(F.lower(F.col(key).cast("string")).alias("m"), F.col(key).alias("first_item"))
    hits = lookup_join(pieces.unionByName(ids), wanted, "m", "left_semi", salts=SALTS)
    first = hits.groupBy("m").agg(F.min("first_item").alias("first_item"))
    return wanted.join(first, "m", "left").select(F.col("m").alias("mention"), "first_item")


def buyers_per_set(sets: DataFrame, sales: DataFrame, customers: DataFrame, n: int, contact: str | None) -> DataFrame:
    """Per set of items (set_id, item_id): number of distinct buyers and the lines of the first ``n``."""
    wanted = sets.select("item_id").distinct()
    pairs = lookup_join(sales.select("item_id", "customer_id"), wanted, "item_id", "left_semi", salts=SALTS).distinct()
    buyers = pairs.join(sets, "item_id").select("set_id", "customer_id").distinct()
    counts = buyers.groupBy("set_id").agg(F.count(F.lit(1)).alias("buyers"))
    order = Window.partitionBy("set_id").orderBy("customer_id")
    first = buyers.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)
    shown = first.join(customers, "customer_id").select(
        "set_id",
        F.struct("position", buyer_line("position", "customer_name", "customer_id", contact).alias("line")).alias("e"),
    )
    lists = shown.groupBy("set_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["line"]), "\n").alias("body")
    )
    return counts.join(lists, "set_id")


def pattern_answers(
    asked: DataFrame, sales: DataFrame, items: DataFrame, customers: DataFrame, n: int = 10, contact: str | None = None
) -> DataFrame:
    """(query_id, answer) for relationship questions: buyers of any mentioned product.

    The answer carries the first mention's name.  Buyers are worked out once per distinct set of
    items, however many questions ask for it.
    """
    found = asked.select("query_id", product_mentions("question", capitalised=False).alias("ms"))
    exploded = found.select("query_id", F.explode("ms").alias("mention"))
    resolved = resolve_mentions(exploded, items).withColumnRenamed("mention", "m")
    per_query = (
        exploded.withColumn("m", F.lower("mention"))
        .join(resolved.filter("first_item IS NOT NULL"), "m")
        .groupBy("query_id")
        .agg(F.sort_array(F.collect_set("first_item")).alias("found_items"))
        .withColumn("set_id", F.array_join(F.transform("found_items", lambda x: x.cast("string")), ","))
    )
    sets = per_query.select("set_id", "found_items").distinct().select("set_id", F.explode("found_items").alias("item_id"))
    buyers = buyers_per_set(sets, sales, customers, n, contact)
    first = F.get("ms", F.lit(0))
    quoted = F.concat(F.lit("'"), first, F.lit("'"))
    more = F.when(
        F.col("buyers") > n,
        F.concat(F.lit("\n... and "), (F.col("buyers") - n).cast("string"), F.lit(" more customers")),
    ).otherwise("")
    answer = (
        F.when(F.size("ms") == 0, F.lit(NO_MENTION))
        .when(F.col("set_id").isNull(), F.concat(F.lit("Product "), quoted, F.lit(" not found")))
        .when(F.col("buyers").isNull(), F.concat(F.lit("No customers found who bought "), quoted))
        .otherwise(
            F.concat(
                F.lit("Customers who bought "),
                quoted,
                F.lit(":\nFound "),
                F.col("buyers").cast("string"),
                F.lit(" customers:\n"),
                F.col("body"),
                more,
            )
        )
    )
    return (
        found.join(per_query.select("query_id", "set_id"), "query_id", "left")
        .join(buyers, "set_id", "left")
        .select("query_id", answer.alias("answer"))
    )


def answer_batch(
    questions: DataFrame,
    nodes: DataFrame,
    sales: DataFrame,
    items: DataFrame,
    customers: DataFrame,
    encoder: TermModel | Callable[[], object] = TermModel(),
    top_k: int = 5,
    contact: str | None = None,
    element: str = "float",
) -> DataFrame:
    """(question_id, route, answer) for every row of (question_id, question).

    ``nodes`` has node_id, node_text and embedding.  Each distinct question text is answered once; a null
    question is answered as the empty text.
    """
    asked = questions.select("question_id", F.coalesce("question", F.lit("")).alias("question"))
    log = asked.withColumn("query_id", F.sha2("question", 256))
    # Every branch below starts from the distinct texts: they are worked out and written once.
    texts = asked.select("question").distinct().withColumn("query_id", F.sha2("question", 256))
    texts = cut_lineage(texts.select("query_id", "question", deployed_route("question").alias("route")))
    searched = texts.filter("route <> 'pattern'")
    queries = cut_lineage(embed_queries(searched, "question", encoder, element=element))
    ranked = batch_semantic_search(nodes, queries, top_k)
    semantic = semantic_answers(searched, semantic_lines(ranked, nodes))
    patterns = pattern_answers(texts.filter("route = 'pattern'"), sales, items, customers, contact=contact)
    bodies = semantic.unionByName(patterns)
    note = F.when(F.col("route") == "aggregation", F.lit(AGGREGATION_NOTE)).otherwise("")
    answered = texts.select("query_id", "route").join(bodies, "query_id").select(
        "query_id", "route", F.concat(note, "answer").alias("answer")
    )
    return lookup_join(log.select("question_id", "query_id"), answered, "query_id", salts=4).select(
        "question_id", "route", "answer"
    )


PERIOD = ("year", "month", "quarter")

# -- relations asked for with a second product or a period --------------------------------------------


def _month_rows(periods: DataFrame) -> DataFrame:
    """``periods`` with the months (y, m) that each covers; y is 0 for a period without year."""
    inside = F.expr(
        "filter(sequence(1L, 12L), m -> (month IS NULL OR m = month) AND (quarter IS NULL OR (m + 2) div 3 = quarter))"
    )
    return periods.select("*", F.explode(inside).alias("m")).withColumn("y", F.coalesce("year", F.lit(0).cast("bigint")))


def answer_relations(
    questions: DataFrame,
    sales: DataFrame,
    items: DataFrame,
    customers: DataFrame,
    n: int = 10,
    contact: str | None = None,
    date_column: str = "sale_date",
) -> DataFrame:
    """J1, relation route: (question_id, answer) for who bought the first mentioned product, and the second if there is one.

    A period in the question (year, month, quarter; months are read strictly) holds for both products.  The sales of
    all products that somebody mentions are read once and folded to the months in which a customer bought a product.
    Each distinct (products, period) then joins its months and folds a customer's rows to "bought a", "bought b".
    """
    texts = questions.select("question").filter(is_pattern("question") & F.col("question").isNotNull()).distinct()
    found = texts.select(
        "question",
        product_mentions("question", capitalised=False).alias("ms"),
        year_of("question").alias("year"),
        month_of("question", strict=True).alias("month"),
        quarter_of("question").alias("quarter"),
    ).withColumns({"mention_a": F.get("ms", F.lit(0)), "mention_b": F.get("ms", F.lit(1))})
    found = cut_lineage(found)
    mentions = found.select(F.explode(F.array_compact(F.array("mention_a", "mention_b"))).alias("mention"))
    resolved = cut_lineage(resolve_mentions(mentions, items))
    for end in ("a", "b"):
        known = resolved.select(F.col("mention").alias(f"lower_{end}"), F.col("first_item").alias(f"item_{end}"))
        found = lookup_join(found.withColumn(f"lower_{end}", F.lower(f"mention_{end}")), known, f"lower_{end}", "left")
    key = ("item_a", "item_b", *PERIOD)
    known = F.col("item_a").isNotNull() & (F.col("mention_b").isNull() | F.col("item_b").isNotNull())
    wanted = found.filter(known).select(*key).distinct()

    ends = [F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("item_id"), F.lit(c).alias("end"))) for c in key[:2]]
    asked = _month_rows(wanted.select("*", F.inline(F.array_compact(F.array(*ends)))))
    day = F.col(date_column)
    bought = lookup_join(sales, asked.select("item_id").distinct(), "item_id", "left_semi", salts=SALTS)
    months = [F.year(day).cast("bigint").alias("y"), F.month(day).cast("bigint").alias("m")]
    bought = bought.select("item_id", "customer_id", *months).distinct()
    bought = bought.unionByName(bought.withColumn("y", F.lit(0).cast("bigint")).distinct())
    sides = lookup_join(bought, asked, ["item_id", "y", "m"], salts=SALTS).groupBy(*key, "customer_id")
    second = F.col("item_b").isNull() | (F.col("end") == "item_b")
    folded = cut_lineage(sides.agg(F.max(F.col("end") == "item_a").alias("a"), F.max(second).alias("b")))
    counts = folded.groupBy(*key).agg(
        F.count_if("a").alias("n_a"), F.count_if("b").alias("n_b"), F.count_if(F.col("a") & F.col("b")).alias("buyers")
    )
    order = Window.partitionBy(*key).orderBy("customer_id")
    first = folded.filter("a AND b").withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)
    line = buyer_line("position", "customer_name", "customer_id", contact).alias("line")
    shown = first.join(customers, "customer_id").select(*key, F.struct("position", line).alias("e"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["line"]), "\n")
    lists = shown.groupBy(*key).agg(body.alias("body"))

    when = date_phrase(F.col("f.year"), F.col("f.month"), F.col("f.quarter"))
    a, b = (F.concat(F.lit("'"), F.col(f"f.mention_{end}"), F.lit("'")) for end in "ab")
    pair = F.col("f.mention_b").isNotNull()
    title = F.when(pair, F.concat(F.lit("Customers who bought both "), a, F.lit(" AND "), b))
    title = F.concat(title.otherwise(F.concat(F.lit("Customers who bought "), a)), when, F.lit(":\n"))
    note = [
        F.concat(F.lit("\n  • "), F.coalesce(f"c.n_{end}", F.lit(0)).cast("string"), F.lit(" customers bought "), name, when)
        for end, name in (("a", a), ("b", b))
    ]
    neither = F.concat(F.lit("No customers found who purchased both products"), when, F.lit(".\nNote:"), *note)
    nobody = F.concat(F.lit("No customers found who purchased this product"), when, F.lit("."))
    buyers = F.coalesce("c.buyers", F.lit(0).cast("bigint"))
    more = F.concat(F.lit("\n... and "), (buyers - n).cast("string"), F.lit(" more customers"))
    listed = F.concat(
        F.lit("Found "), buyers.cast("string"), F.lit(" customers:\n"), F.col("l.body"), F.when(buyers > n, more).otherwise("")
    )
    missing = F.when(F.col("f.item_a").isNull(), a).when(pair & F.col("f.item_b").isNull(), b)
    answer = (
        F.when(F.size("f.ms") == 0, F.lit(NO_MENTION))
        .when(missing.isNotNull(), F.concat(F.lit("Product "), missing, F.lit(" not found")))
        .otherwise(F.concat(title, F.when(buyers > 0, listed).when(pair, neither).otherwise(nobody)))
    )
    per_text = found.alias("f").join(counts.alias("c"), _same("f", "c", key), "left")
    per_text = per_text.join(lists.alias("l"), _same("f", "l", key), "left").select("f.question", answer.alias("answer"))
    asked_by = questions.select("question_id", "question")
    return lookup_join(asked_by, per_text, "question", salts=4).select("question_id", "answer")


# -- rankings asked for in a table of questions ------------------------------------------------------

_DEALT = 64


def monthly_totals(fact: DataFrame, config: StarConfig = RETAIL) -> DataFrame:
    """(entity_type, key, y, m, one sum per measure, transactions) of all dimensions in one pass over the fact.

    Most months of a key hold few sales: sales are added up after the shuffle only, in pieces that no task needs much memory for.
    """
    keys = [e.fact_key for e in config.entities]
    kinds = {fact.schema[k].dataType.simpleString() for k in keys}
    kind = kinds.pop() if len(kinds) == 1 else "string"
    day = F.col(config.date_column)
    rows = fact.select(*keys, *config.measures, F.year(day).cast("bigint").alias("y"), F.month(day).cast("bigint").alias("m"))
    sums = [F.sum(x).alias(x) for x in config.measures]
    ends = [F.struct(F.lit(i).alias("entity"), F.col(k).cast(kind).alias("key")) for i, k in enumerate(keys)]
    sold = rows.filter("m IS NOT NULL").select(F.inline(F.array(*ends)), "y", "m", *config.measures).filter("key IS NOT NULL")
    months = dealt(sold, "entity", "key", "y", "m").groupBy("entity", "key", "y", "m").agg(*sums, F.count(F.lit(1)).alias("transactions"))
    named = F.get(F.array(*[F.lit(e.table) for e in config.entities]), F.col("entity"))
    return months.select(named.alias("entity_type"), "key", "y", "m", *config.measures, "transactions")


def _same(a: str, b: str, columns: Sequence[str]) -> Column:
    """Equal in all ``columns`` of two aliased tables; null equals null."""
    return reduce(and_, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns])


def _best_keys(totals: DataFrame, wanted: DataFrame, measures: Sequence[str], most: int) -> DataFrame:
    """The first ``most`` keys of each ranking; a ranking is dealt out and cut before one task orders the rest."""
    named = ["entity_type", *PERIOD, "measure", "is_bottom"]
    value = F.when(F.col("measure") == "COUNT(*)", F.col("transactions").cast("double"))
    for column in measures:
        value = value.when(F.col("measure") == column, F.col(column).cast("double"))
    both = totals.alias("t").join(F.broadcast(wanted.alias("w")), _same("t", "w", ("entity_type", *PERIOD)))
    both = both.select(*[F.col(f"w.{c}").alias(c) for c in named], "key", "label", value.alias("value"))
    # The sign turns "lowest first" into "highest first".
    both = both.withColumn("place", F.when(F.col("is_bottom"), -F.col("value")).otherwise(F.col("value")))
    both = both.withColumn("dealt", F.pmod(F.xxhash64("key"), F.lit(_DEALT)))
    order = (F.desc("place"), F.asc("key"))
    few = both.withColumn("p", F.row_number().over(Window.partitionBy(*named, "dealt").orderBy(*order)))
    few = few.filter(F.col("p") <= most)
    last = few.withColumn("p", F.row_number().over(Window.partitionBy(*named).orderBy(*order)))
    return last.filter(F.col("p") <= most).select(*named, "p", "label", "value")


def answer_simple(
    questions: DataFrame,
    fact: DataFrame,
    dims: Mapping[str, DataFrame],
    config: StarConfig = RETAIL,
    default_limit: int = 5,
) -> DataFrame:
    """J1, simple route: (question_id, answer) for every question that a ranked aggregate answers.

    The questions become a table of intents (measure, entity, limit, direction, period).  The fact is aggregated
    once, by month and for all dimensions, whatever the number of questions; each period that somebody asks for adds
    up its months, and each distinct ranking is worked out once.  Keys without a dimension row are left out.
    Limits, months and directions are read strictly.
    """
    texts = questions.select("question").filter("question IS NOT NULL").distinct()
    asked = cut_lineage(classify(texts, config=config, strict=True).filter("route = 'simple'")).withColumn(
        "limit", F.coalesce("limit", F.lit(default_limit).cast("bigint"))
    )
    ranking = ["entity_type", *PERIOD, "measure", "is_bottom"]
    intents = asked.select(*ranking, "limit").distinct()
    most = asked.agg(F.max("limit")).first()[0] or 0
    wanted = intents.select(*ranking).distinct()

    # Periods are years from 2000 to 2099 or none, with a month or quarter or none: a bounded table.
    periods = _month_rows(wanted.select("entity_type", *PERIOD).distinct())
    months = monthly_totals(fact, config)
    sums = [F.sum(x).alias(x) for x in (*config.measures, "transactions")]
    # A month counts for the periods of its year and for those of every year.
    years = months.withColumn("y", F.explode(F.array("y", F.lit(0).cast("bigint"))))
    covered = years.join(F.broadcast(periods), ["entity_type", "y", "m"])
    totals = dealt(covered, "entity_type", "key").groupBy("entity_type", *PERIOD, "key").agg(*sums)
    labels = None
    for e in config.entities:
        part = dims[e.table].select(F.lit(e.table).alias("entity_type"), F.col(e.key).alias("key"), F.col(e.label).alias("label"))
        labels = part if labels is None else labels.unionByName(part)
    # A key has a row for each period, so none is hot.
    totals = lookup_join(totals, labels, ["entity_type", "key"], salts=1)

    best = _best_keys(totals, wanted, config.measures, most)
    text = (
        F.when(F.col("measure") == "total_sales_value", F.concat(F.lit("$"), F.format_number("value", 2)))
        .when(F.col("measure") == "COUNT(*)", F.concat(F.format_number(F.col("value").cast("bigint"), 0), F.lit(" transactions")))
        .otherwise(F.concat(F.format_number("value", 0), F.lit(" units")))
    )
    line = F.concat(F.col("p").cast("string"), F.lit(". "), "label", F.lit(" - "), text)
    lists = best.groupBy(*ranking).agg(F.sort_array(F.collect_list(F.struct("p", line.alias("line")))).alias("lines"))
    when = date_phrase(F.col("a.year"), F.col("a.month"), F.col("a.quarter"))
    title = F.concat(
        F.when(F.col("a.is_bottom"), F.lit("Bottom ")).otherwise(F.lit("Top ")),
        F.col("a.limit").cast("string"),
        F.lit(" "),
        F.translate("a.entity_type", "_", " "),
        when,
        F.lit(" by "),
        F.col("a.measure"),
        F.lit(":"),
    )
    shown = F.transform(F.filter("l.lines", lambda e: e["p"] <= F.col("a.limit")), lambda e: e["line"])
    answer = F.when(F.size("l.lines") > 0, F.concat_ws("\n", title, F.array_join(shown, "\n"))).otherwise(
        F.concat(F.lit("No data found for the specified filters"), when, F.lit("."))
    )
    answers = intents.alias("a").join(lists.alias("l"), _same("a", "l", ranking), "left")
    answers = answers.select(*[F.col(f"a.{c}").alias(c) for c in (*ranking, "limit")], answer.alias("answer"))
    per_text = asked.alias("t").join(answers.alias("x"), _same("t", "x", (*ranking, "limit"))).select("t.question", "x.answer")
    return lookup_join(questions.select("question_id", "question"), per_text, "question", salts=4).select("question_id", "answer")
