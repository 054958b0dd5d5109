"""Generated stars, files and rules."""

import pytest
from pyspark.sql import functions as F

from starlens.config import RETAIL, resolve_encoder
from starlens.operators import dictionary as dd
from starlens.operators.evaluate import result_diff, success_rate
from starlens.sources import tables
from starlens.sources.retail import denormalize, generate_star


@pytest.fixture(scope="module")
def star(spark):
    return generate_star(spark, 2000, seed=3)


def test_generated_star(spark, star):
    facts = star["items_sales"]
    again = generate_star(spark, 2000, seed=3)["items_sales"].repartition(3)
    assert result_diff(facts, again).isEmpty()
    assert not result_diff(facts, generate_star(spark, 2000, seed=4)["items_sales"]).isEmpty()
    low, high, worst = facts.agg(
        F.min("units_sold"), F.max("units_sold"), F.max(F.col("total_sales_value") / F.col("units_sold"))
    ).first()
    assert (low, high) == (1, 20) and worst <= 10.01
    assert dict(facts.dtypes)["units_sold"] == "bigint" and dict(facts.dtypes)["sale_date"] == "date"


def test_rules_hold_on_generated_star(spark, star):
    rules = [
        dd.ForeignKey("item", "items_sales", "item_id", "item_details", "item_id"),
        dd.ForeignKey("store", "items_sales", "location_id", "store_location", "location_id"),
        dd.positive("units", "items_sales", "units_sold"),
        dd.not_after("future", "items_sales", "sale_date", "2026-01-01"),
        dd.matches("item id", "item_details", "item_id", dd.ITEM_ID),
        dd.matches("store id", "store_location", "location_id", dd.LOCATION_ID),
        dd.matches("customer id", "customer_details", "customer_id", dd.CUSTOMER_ID),
        dd.matches("mail", "customer_details", "customer_email", dd.EMAIL),
        dd.matches("zip", "customer_details", "customer_zip_code", dd.ZIP_CODE),
        dd.max_length("name", "item_details", "item_name", 100),
        dd.Unique("unique", "store_location", ("location_name",)),
    ]
    got = dd.run_rules(star, rules).collect()
    assert len(got) == len(rules) and all(r["violations"] == 0 and r["checked"] > 0 for r in got)
    bad = {**star, "customer_details": star["customer_details"].withColumn("customer_zip_code", F.lit("12a45"))}
    assert dd.run_rules(bad, rules[8:9]).first()["violations"] == 200


def test_wide_view_keeps_all_sales(star):
    wide = denormalize(
        star["items_sales"],
        [
            (star["item_details"], "item_id", "item_id"),
            (star["store_location"], "location_id", "location_id"),
            (star["customer_details"], "customer_id", "customer_id"),
        ],
    )
    assert wide.count() == 2000
    assert len(set(wide.columns)) == len(wide.columns)


def test_csv_with_quoted_commas(spark, tmp_path):
    path = tmp_path / "stores.csv"
    path.write_text('location_id,location_name,location_description\nl-1,Springfield,"Store in Springfield, ""old"" town"\n')
    row = tables.load_csv_dimension(spark, str(path), table="store_location").first()
    assert tuple(row) == ("l-1", "Springfield", 'Store in Springfield, "old" town')


def test_zip_stays_text(spark, tmp_path):
    path = tmp_path / "customers.csv"
    path.write_text("customer_id,customer_name,customer_email,customer_zip_code\nc-1,Ann,ann@example.com,01234\n")
    assert tables.load_csv_dimension(spark, str(path), table="customer_details").first()[3] == "01234"


def test_inferred_and_explicit_rows(spark):
    named = tables.rows_to_table(spark, [("a", 1)], ["name", "units"])
    assert dict(named.dtypes)["units"] == "bigint"


def test_overwrite_replaces_schema(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.save_table(spark.range(3), path=path)
    tables.save_table(spark.range(2).withColumn("x", F.lit("y")), path=path)
    assert spark.read.parquet(path).columns == ["id", "x"] and spark.read.parquet(path).count() == 2


def test_dictionary_schema(spark, star):
    notes = {"item_details": dd.TableNote("dimension", "Items", None, {"item_id": dd.ColumnNote("Number", True)})}
    d = dd.build_dictionary(star, notes)
    assert d.columns == [f.name for f in dd.DICTIONARY_SCHEMA.fields]
    rows = {r["column_name"]: r for r in d.collect()}
    assert rows[None]["sample_values"] == "50 rows" and rows["item_id"]["sample_values"] == "p-1, p-10, p-11"


def test_config():
    assert RETAIL.fk_mapping == {
        "item_id": "item_details",
        "location_id": "store_location",
        "customer_id": "customer_details",
    }
    assert resolve_encoder("bge-m3").dims == 1024 and resolve_encoder("custom") is None


def test_success_rate(spark):
    answers = spark.createDataFrame([("fine",), ("An Error",), ("we cannot",), (None,)], "answer string")
    assert tuple(success_rate(answers).first()) == (4, 1, 25.0)


def test_generated_facts_do_not_depend_on_partitions(spark):
    from starlens.sources.retail import generated_facts

    keys = spark.range(500).select("id", (F.col("id") % 3).alias("k")).unionAll(spark.sql("SELECT CAST(NULL AS BIGINT), 1L"))
    one = generated_facts(keys.repartition(1), ["id", "k"], seed=9)
    assert result_diff(one, generated_facts(keys.repartition(7), ["id", "k"], seed=9)).isEmpty()
    assert one.count() == 501 and one.filter("total_sales_value IS NULL OR units_sold NOT BETWEEN 1 AND 20").isEmpty()
    assert one.select("item_id").distinct().count() == 50
    assert generated_facts(keys.limit(0), ["id", "k"]).isEmpty()


def test_a_value_has_few_files(spark, tmp_path):
    import glob

    rows = spark.range(0, 20_000, 1, 16).withColumn("year", F.when(F.col("id") % 10 < 7, 2000).otherwise(F.col("id") % 9))
    path = str(tmp_path / "years")
    tables.save_table(rows, path=path, partition_by=["year"])
    files = [len(glob.glob(f"{d}/*.parquet")) for d in glob.glob(f"{path}/year=*")]
    assert len(files) == 10 and max(files) == 1
    assert spark.read.parquet(path).count() == 20_000
    tables.save_table(rows, path=path, partition_by=["year"], max_rows_per_file=1000)
    assert len(glob.glob(f"{path}/year=2000/*.parquet")) == 14
    tables.save_table(rows.limit(0), path=path, partition_by=["year"])
    assert not glob.glob(f"{path}/year=*")


def _read(df):
    """What a plan reads: (file, columns) of each scan."""
    import re

    plan = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    where = re.findall(r"Location: .*?/(\w+)\.parquet\]", plan)
    return set(zip(where, re.findall(r"ReadSchema: (\S+)", plan)))


def test_dictionary_reads_only_what_is_asked_for(spark):
    from starlens import plans

    queries = plans.all_queries()
    root = "/root/testdata/sf0.001"
    measures = _read(queries["h4_dictionary_measures"](spark, root))
    assert measures == {("lineitem", "struct<l_quantity:double,l_extendedprice:double>")}
    sizes = _read(queries["h2_dictionary_tables"](spark, root))
    assert {t for t, _ in sizes} == {"lineitem", "part", "nation", "customer"}
    assert all(columns.count(":") <= 1 for _, columns in sizes)
    assert not _read(queries["j5_rich_context_used"](spark, root))


def test_dictionary_has_a_row_for_each_column(spark, star):
    notes = {"item_details": dd.TableNote("dimension", "Items", columns={"item_id": dd.ColumnNote("Id", True), "gone": dd.ColumnNote("Lost")})}
    rows = dd.build_dictionary(star, notes).collect()
    assert {r.column_name for r in rows} == {None, "item_id", "item_name", "item_description", "gone"}
    by_name = {r.column_name: r for r in rows}
    assert by_name["gone"].column_type is None and by_name["gone"].sample_values is None
    assert by_name["item_name"].sample_values and by_name["item_name"].column_description is None
    assert dd.build_dictionary(star, notes, asked=lambda r: False).isEmpty()
