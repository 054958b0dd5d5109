"""H*: data dictionary and rules over the star."""

from __future__ import annotations

from pyspark.sql import functions as F

from starlens.joins import lookup_join
from starlens.operators import dictionary as dd
from starlens.operators.dictionary import ColumnNote, TableNote
from starlens.plans.book import Book, with_star
from starlens.sources.tables import describe_tables, profile_columns

book = Book()

NOTES = {
    "items_sales": TableNote(
        "fact",
        "Sold items with quantity, revenue, day, buyer and place",
        "One row per item of an order.",
        {
            "item_id": ColumnNote("Item sold", True, related="item_details", rules="Must exist in item_details."),
            "location_id": ColumnNote("Place of the sale", True, related="store_location", rules="Must exist in store_location."),
            "customer_id": ColumnNote("Buyer", True, related="customer_details", rules="Must exist in customer_details."),
            "sale_date": ColumnNote("Day of the order", rules="Never in the future."),
            "units_sold": ColumnNote("Quantity", is_measure=True, rules="Positive."),
            "total_sales_value": ColumnNote("Revenue; the main measure", is_measure=True, rules="Positive."),
        },
    ),
    "item_details": TableNote(
        "dimension",
        "Items",
        "Current items.",
        {
            "item_id": ColumnNote("Item number", True, related="items_sales", rules="Unique."),
            "item_name": ColumnNote("Display name", rules="At most 100 characters."),
            "item_description": ColumnNote("Brand and type"),
        },
    ),
    "store_location": TableNote(
        "dimension",
        "Places of sale",
        None,
        {
            "location_id": ColumnNote("Place number", True, related="items_sales"),
            "location_name": ColumnNote("Name", rules="Unique."),
        },
    ),
    "customer_details": TableNote(
        "dimension",
        "Customers",
        "Personal data.",
        {
            "customer_id": ColumnNote("Customer number", True, rules="Unique."),
            "customer_name": ColumnNote("Full name", rules="Unique."),
            "customer_segment": ColumnNote("Market segment; not a measure of value"),
        },
    ),
}

TYPES = {
    "items_sales": {
        "order_id": "bigint",
        "item_id": "bigint",
        "supplier_id": "bigint",
        "location_id": "bigint",
        "customer_id": "bigint",
        "sale_date": "timestamp_ntz",
        "units_sold": "double",
        "total_sales_value": "double",
    },
    "item_details": {"item_id": "bigint", "item_name": "string", "item_description": "string"},
    "store_location": {"location_id": "bigint", "location_name": "string", "region_id": "bigint"},
    "customer_details": {
        "customer_id": "bigint",
        "customer_name": "string",
        "customer_segment": "string",
        "customer_nation": "bigint",
    },
}
VIEWS = {"items_sales": "sales", "item_details": "items", "store_location": "locations", "customer_details": "customers"}


def star_tables(r):
    return {
        "items_sales": r.sales(),
        "item_details": r.items(),
        "store_location": r.locations(),
        "customer_details": r.customers(),
    }


def sources(r):
    """The same, but the fact joins orders and suppliers only for columns that come from them."""
    return {**star_tables(r), "items_sales": r.sales}


def dictionary(r, asked=lambda row: True, samples=3):
    return dd.build_dictionary(sources(r), NOTES, "main", "retail", samples, asked)


def _text(column, kind):
    if kind == "double":
        return f"CAST(CAST({column} AS DECIMAL(20,2)) AS VARCHAR)"
    if kind == "timestamp_ntz":
        return f"strftime({column}, '%Y-%m-%d')"
    return f"CAST({column} AS VARCHAR)"


def _lit(value):
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    return "'" + value.replace("'", "''") + "'"


SAMPLES = "samples AS (\n" + "\nUNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, string_agg(v, ', ' ORDER BY v) AS sample_values "
    f"FROM (SELECT DISTINCT {_text(c, kind)} AS v FROM {VIEWS[t]} ORDER BY v LIMIT 3)"
    for t, columns in TYPES.items()
    for c, kind in columns.items()
) + ")"

SIZES = "sizes AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n FROM {v}" for t, v in VIEWS.items()
) + ")"

_ROWS = (
    [(t, n.kind, n.description, None, None, None, False, False, None, n.rules) for t, n in NOTES.items()]
    + [
        (t, n.kind, n.description, c, TYPES[t][c], k.description, k.is_key, k.is_measure, k.related, k.rules)
        for t, n in NOTES.items()
        for c, k in n.columns.items()
    ]
    + [
        (t, n.kind, n.description, c, kind, None, False, False, None, None)
        for t, n in NOTES.items()
        for c, kind in TYPES[t].items()
        if c not in n.columns
    ]
)
DICTIONARY = f"""{SAMPLES}, {SIZES},
written(table_name, table_type, table_description, column_name, column_type, column_description, is_key, is_measure,
        related_table, business_rules) AS (VALUES
  {", ".join("(" + ", ".join(_lit(v) for v in row) + ")" for row in _ROWS)}),
dictionary AS (
  SELECT 'main' AS catalog, 'retail' AS schema, w.*, CASE WHEN w.column_name IS NULL THEN z.n || ' rows'
         ELSE s.sample_values END AS sample_values
  FROM written w LEFT JOIN samples s USING (table_name, column_name) LEFT JOIN sizes z USING (table_name))"""


def _query(name: str, body: str):
    return book.query(name, with_star(f", {DICTIONARY}\n{body}"))


def _filled(df):
    """Missing texts as empty strings, so that both engines show them alike."""
    return df.fillna("", subset=[f.name for f in df.schema.fields if f.dataType.simpleString() == "string"])


def _blank(*columns):
    return ", ".join(f"coalesce({c}, '') AS {c}" for c in columns)


@_query(
    "h1_build_dictionary",
    f"""SELECT catalog, schema, table_name, table_type, table_description, is_key, is_measure,
    {_blank('column_name', 'column_type', 'column_description', 'related_table', 'business_rules', 'sample_values')}
    FROM dictionary""",
)
def h1(r):
    return _filled(dictionary(r))


@_query(
    "h2_dictionary_tables",
    f"""SELECT DISTINCT table_name, table_type, table_description, {_blank('business_rules')}, sample_values
    FROM dictionary WHERE column_name IS NULL""",
)
def h2(r):
    return _filled(dd.dictionary_tables(dictionary(r, lambda row: row.column_name is None)))


@_query(
    "h3_dictionary_columns",
    f"""SELECT column_name, column_type, {_blank('column_description', 'related_table')}, is_key, is_measure, sample_values
    FROM dictionary WHERE table_name = 'items_sales' AND column_name IS NOT NULL""",
)
def h3(r):
    of_fact = dictionary(r, lambda row: row.table_name == "items_sales" and row.column_name is not None)
    return _filled(dd.dictionary_columns(of_fact, "items_sales"))


@_query(
    "h4_dictionary_measures",
    """SELECT table_name, column_name, column_type, column_description, business_rules, sample_values
    FROM dictionary WHERE is_measure""",
)
def h4(r):
    return dd.dictionary_measures(dictionary(r, lambda row: row.is_measure))


@_query(
    "h5_dictionary_relationships",
    """SELECT table_name AS source_table, column_name AS key_column, related_table AS target_table,
    CASE WHEN table_type = 'fact' THEN 'foreign key' ELSE 'referenced by' END AS direction, column_description,
    sample_values FROM dictionary WHERE is_key AND related_table IS NOT NULL""",
)
def h5(r):
    return dd.dictionary_relationships(dictionary(r, lambda row: row.is_key and row.related_table is not None))


@_query(
    "h6_dictionary_counts",
    """SELECT table_name, count(*) AS entry_count, count(*) FILTER (column_name IS NULL) AS table_level,
    count(column_name) AS column_level, count(sample_values) AS with_samples FROM dictionary GROUP BY table_name""",
)
def h6(r):
    return dd.dictionary_counts(dictionary(r))


PROFILE = "profile AS (\n" + "\nUNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS col_name, count(*) AS row_count, count({c}) AS non_null FROM {VIEWS[t]}"
    for t, columns in TYPES.items()
    for c in columns
) + ")"


@_query(
    "h7_undocumented_columns",
    f""", {PROFILE}
    SELECT table_name, col_name, row_count, non_null FROM profile p
    WHERE NOT EXISTS (SELECT 1 FROM dictionary d WHERE d.table_name = p.table_name AND d.column_name = p.col_name
                      AND d.column_description IS NOT NULL)""",
)
def h7(r):
    tables = star_tables(r)
    known = dd.build_dictionary(tables, NOTES, "main", "retail", samples=None)
    return dd.undocumented_columns(profile_columns(tables), known)


@book.query("h8_sample_values", with_star(f", {SAMPLES} SELECT * FROM samples"))
def h8(r):
    return dd.sample_values(sources(r), 3)


DOCUMENTS = """lines AS (
  SELECT *, '• ' || column_name || ' (' || column_type || ')'
    || CASE WHEN is_key AND related_table IS NULL THEN ' [PRIMARY KEY]' ELSE '' END
    || CASE WHEN related_table IS NOT NULL THEN ' [FOREIGN KEY → ' || related_table || ']' ELSE '' END
    || CASE WHEN is_measure THEN ' [MEASURE]' ELSE '' END
    || coalesce(chr(10) || '  Description: ' || column_description, '')
    || CASE WHEN business_rules IS NOT NULL THEN chr(10) || '  Business Rules: ' || business_rules ELSE '' END
    || chr(10) || '  Sample Values: ' || sample_values AS line
  FROM dictionary WHERE column_name IS NOT NULL),
documents_of AS (
  SELECT 'table' AS section, h.table_name, 'TABLE: main.retail.' || h.table_name || ' (' || upper(h.table_type) || ')' || chr(10)
    || 'Description: ' || h.table_description || chr(10) || 'COLUMNS:' || chr(10)
    || (SELECT string_agg(line, chr(10) ORDER BY is_key DESC, is_measure DESC, column_name) FROM lines l
        WHERE l.table_name = h.table_name) AS document
  FROM dictionary h WHERE column_name IS NULL
  UNION ALL
  SELECT 'relationships', '', string_agg(t, chr(10) ORDER BY t) FROM (
    SELECT 'main.retail.' || table_name || '.' || column_name || ' → main.retail.' || related_table AS t
    FROM dictionary WHERE is_key AND related_table IS NOT NULL)
  UNION ALL
  SELECT 'measures', '', string_agg(t, chr(10) ORDER BY t) FROM (
    SELECT '• ' || column_name || ': ' || column_description AS t FROM dictionary WHERE is_measure))"""


@_query("h9_context_documents", f", {DOCUMENTS} SELECT section, table_name, document FROM documents_of")
def h9(r):
    return dd.context_documents(dictionary(r), "main.retail")


@_query(
    "j5_rich_context_used",
    f""", {DOCUMENTS}
    SELECT section, table_name, contains(document, 'Business Rules:') AS rich_context FROM documents_of""",
)
def j5(r):
    return dd.rich_context_used(dd.context_documents(dictionary(r, samples=None))).drop("document")


@_query(
    "h10_basic_schema_documents",
    "\nUNION ALL ".join(
        "SELECT '{t}' AS table_name, '{kind}: {t}' || chr(10) || 'Columns:' || chr(10) || {cols} AS document, "
        "(SELECT n FROM sizes WHERE table_name = '{t}') AS row_count".format(
            t=t,
            kind="Fact Table" if t == "items_sales" else "Dimension Table",
            cols=" || chr(10) || ".join(f"'  - {c} ({kind})'" for c, kind in columns.items()),
        )
        for t, columns in TYPES.items()
    ),
)
def h10(r):
    documents = dd.basic_schema_documents(describe_tables(star_tables(r)), "items_sales")
    return documents.join(dd.table_sizes(sources(r)), "table_name")


def _priced(r):
    prices = r.table("part").select(F.col("p_partkey").alias("item_id"), "p_retailprice")
    return lookup_join(r.sales("item_id", "units_sold", "total_sales_value"), prices, "item_id")


@book.star(
    "h11_run_rules",
    """
    , n AS (SELECT count(*) AS c FROM sales)
    SELECT 'item exists' AS rule, (SELECT c FROM n) AS checked, count(*) AS violations FROM sales
      WHERE item_id NOT IN (SELECT item_id FROM items)
    UNION ALL SELECT 'customer exists', (SELECT c FROM n), count(*) FROM sales WHERE customer_id NOT IN (SELECT customer_id FROM customers)
    UNION ALL SELECT 'location exists', (SELECT c FROM n), count(*) FROM sales WHERE location_id NOT IN (SELECT location_id FROM locations)
    UNION ALL SELECT 'building customer', (SELECT c FROM n), count(*) FROM sales
      WHERE customer_id NOT IN (SELECT customer_id FROM customers WHERE customer_segment = 'BUILDING')
    UNION ALL SELECT 'units positive', (SELECT c FROM n), count(*) FROM sales WHERE units_sold <= 0
    UNION ALL SELECT 'value positive', (SELECT c FROM n), count(*) FROM sales WHERE total_sales_value <= 0
    UNION ALL SELECT 'not after June 2001', (SELECT c FROM n), count(*) FROM sales WHERE CAST(sale_date AS DATE) > DATE '2001-06-30'
    UNION ALL SELECT 'value is units times price', (SELECT c FROM n), count(*) FROM sales JOIN part ON item_id = p_partkey
      WHERE NOT abs(total_sales_value - units_sold * p_retailprice) <= 0.01
    UNION ALL SELECT 'customer name format', count(*), count(*) FILTER (NOT regexp_matches(customer_name, '^Customer#[0-9]{9}$')) FROM customers
    UNION ALL SELECT 'item name length', count(*), count(*) FILTER (length(item_name) > 9) FROM items
    UNION ALL SELECT 'item name unique', sum(k), sum(k) FILTER (k > 1) FROM (SELECT count(*) AS k FROM items GROUP BY item_name)
    UNION ALL SELECT 'line number unique', sum(k), sum(k) FILTER (k > 1) FROM (SELECT count(*) AS k FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
)
def h11(r):
    tables = {
        **star_tables(r),
        "building": r.customers().filter("customer_segment = 'BUILDING'"),
        "priced": _priced(r),
        "lineitem": r.table("lineitem"),
    }
    rules = [
        dd.ForeignKey("item exists", "items_sales", "item_id", "item_details", "item_id"),
        dd.ForeignKey("customer exists", "items_sales", "customer_id", "customer_details", "customer_id"),
        dd.ForeignKey("location exists", "items_sales", "location_id", "store_location", "location_id"),
        dd.ForeignKey("building customer", "items_sales", "customer_id", "building", "customer_id"),
        dd.positive("units positive", "items_sales", "units_sold"),
        dd.positive("value positive", "items_sales", "total_sales_value"),
        dd.not_after("not after June 2001", "items_sales", "sale_date", "2001-06-30"),
        dd.product_of("value is units times price", "priced", "total_sales_value", "units_sold", "p_retailprice"),
        dd.matches("customer name format", "customer_details", "customer_name", r"^Customer#\d{9}$"),
        dd.max_length("item name length", "item_details", "item_name", 9),
        dd.Unique("item name unique", "item_details", ("item_name",)),
        dd.Unique("line number unique", "lineitem", ("l_orderkey", "l_linenumber")),
    ]
    return dd.run_rules(tables, rules)


@book.query(
    "h11_run_rules_raw",
    """
    WITH o AS (SELECT * FROM orders WHERE o_orderdate >= DATE '1995-01-01')
    SELECT 'order exists' AS rule, count(*) AS checked, count(*) FILTER (l_orderkey NOT IN (SELECT o_orderkey FROM o)) AS violations FROM lineitem
    UNION ALL SELECT 'supplier exists', count(*), count(*) FILTER (l_suppkey NOT IN (SELECT s_suppkey FROM supplier)) FROM lineitem
    UNION ALL SELECT 'part exists', count(*), count(*) FILTER (l_partkey NOT IN (SELECT p_partkey FROM part)) FROM lineitem
    UNION ALL SELECT 'customer exists', count(*), count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer)) FROM o
    UNION ALL SELECT 'nation exists', count(*), count(*) FILTER (s_nationkey NOT IN (SELECT n_nationkey FROM nation)) FROM supplier""",
)
def h11_raw(r):
    """Rules over raw tables after the orders before 1995 have been archived."""
    tables = {t: r.table(t) for t in ("lineitem", "supplier", "part", "customer", "nation")}
    tables["orders"] = r.table("orders").filter("o_orderdate >= DATE '1995-01-01'")
    rules = [
        dd.ForeignKey("order exists", "lineitem", "l_orderkey", "orders", "o_orderkey"),
        dd.ForeignKey("supplier exists", "lineitem", "l_suppkey", "supplier", "s_suppkey"),
        dd.ForeignKey("part exists", "lineitem", "l_partkey", "part", "p_partkey"),
        dd.ForeignKey("customer exists", "orders", "o_custkey", "customer", "c_custkey"),
        dd.ForeignKey("nation exists", "supplier", "s_nationkey", "nation", "n_nationkey"),
    ]
    return dd.run_rules(tables, rules)


@book.query(
    "h12_duplicate_keys",
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS copies FROM lineitem
    GROUP BY ALL HAVING count(*) > 1""",
)
def h12(r):
    out = dd.duplicate_keys(r.table("lineitem"), ["l_orderkey", "l_linenumber"])
    return out.withColumn("l_linenumber", F.col("l_linenumber").cast("bigint"))


@_query(
    "h13_dictionary_preview",
    f"""SELECT table_name, {_blank('column_name', 'column_type', 'sample_values')} FROM dictionary
    ORDER BY dictionary.table_name, dictionary.column_name NULLS FIRST LIMIT 10""",
)
def h13(r):
    rows = sorted(dd.entries(sources(r), NOTES), key=lambda e: (e.table_name, e.column_name or ""))
    wanted = {(e.table_name, e.column_name) for e in rows[:10]}
    first = dd.dictionary_preview(dictionary(r, lambda e: (e.table_name, e.column_name) in wanted), 10)
    return _filled(first.select("table_name", "column_name", "column_type", "sample_values"))
