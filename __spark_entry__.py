"""

This file only wires names to functions of `ledgerloom`. Reports run for one
billing period, as the operators are meant to be used, and as `*_all_periods`
over the whole table.
"""

from __future__ import annotations

import datetime as dt
import functools
import os
import pickle
import sys
import tempfile
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle_queries
from ledgerloom.functions.arrays import one_hot, parse_matrix
from ledgerloom.functions.money import or_not_available, two_decimals
from ledgerloom.functions.tags import tags_text
from ledgerloom.operators.filters import current_period, dates_between
from ledgerloom.operators.sampling import sample_rows, split_counts, train_test_split
from ledgerloom.plans.bookmarks import Bookmark, convert_new
from ledgerloom.plans import corpus, cost, features, ingest, labels, models, tagging, trend
from ledgerloom.schema import PERIOD as PERIOD_COLUMN
from ledgerloom.schema import money_as_double, normalise_costs
from ledgerloom import session
from ledgerloom.sinks.files import dataset_name, decoded_key, write_csv, write_matrix, write_text_files
from ledgerloom.sinks.named_files import write_named_files
from ledgerloom.sources.catalog import register_table, schema_changes, schema_report
from ledgerloom.sources.evolution import parquet_files, sync_partitions
from ledgerloom.sources.files import batch_files, infer_csv_schema, read_directory, read_image_batches
from ledgerloom.sources.standin import cost_items
from ledgerloom.streaming.arrivals import arriving_csv, ingest_stream
from ledgerloom.streaming.keyed_table import KeyedTable, upsert_stream
from ledgerloom.streaming.label_state import current_labels, label_state_table, label_stream

try:  # the training-data operators can be left out
    import corpus_pipeline
    from ledgerloom.llm import queries as llm_queries
except ImportError:
    corpus_pipeline = llm_queries = None

Query = Callable[[SparkSession, str], DataFrame]

PERIOD = dt.date(1998, 5, 1)
NEXT_PERIOD = dt.date(1998, 6, 1)
PREVIOUS_PERIOD = dt.date(1998, 4, 1)
SERVICE = "Brand#12"
TAG_KEY = "user_creator"
WHEN = dt.datetime(2024, 1, 31, 12, 30, 0)
SMALL_IMAGE = (4, 4, 4)
RESPONSE_EVENTS = 100  # events with consecutive ids that count as one response


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="ledgerloom-")


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A folder for what a query writes; one process without a shared folder uses a local one."""
    return session.scratch_dir(spark, purpose, _local_root() if session.runs_in_one_process(spark) else None)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Reports


def _report(report, *args, **options) -> Query:
    """A report on one billing period; only that month of the table is scanned."""

    def run(spark, folder):
        items = cost_items(spark, folder, report.columns, start=PERIOD, end=NEXT_PERIOD)
        return money_as_double(report(items, *args, period=PERIOD, **options))

    return run


def _report_all(report, *args, **options) -> Query:
    def run(spark, folder):
        return money_as_double(report(cost_items(spark, folder, report.columns), *args, **options))

    return run


def _detail_with_text_tags(report) -> Query:
    def run(spark, folder):
        return report(spark, folder).withColumn("tags", tags_text(F.col("tags")))

    return run


def _month_over_month(spark, folder):
    report = cost.month_over_month
    items = cost_items(spark, folder, report.columns, start=PREVIOUS_PERIOD, end=NEXT_PERIOD)
    return money_as_double(report(items, PERIOD, PREVIOUS_PERIOD))


def _week_over_week(weeks: trend.Weeks) -> Query:
    """The two steps of the report, each over items with only the columns it reads."""

    def run(spark, folder):
        def items(step):
            end = weeks.current_end + dt.timedelta(days=1)
            return cost_items(spark, folder, step.columns, weeks.previous_start, end, resource_key="l_suppkey")

        totals = trend.weekly_totals(items(trend.weekly_totals), weeks)
        return money_as_double(trend.with_places(totals, items(trend.with_places), weeks))

    return run


def _monthly_report(part: str) -> Query:
    def run(spark, folder):
        report = tagging.monthly_tagging_report
        items = cost_items(spark, folder, report.columns, start=PERIOD, end=NEXT_PERIOD)
        written = report(items, TAG_KEY, PERIOD, scratch_dir(spark, "monthly-report"))
        return spark.read.option("header", True).csv(written[part])

    return run


# Reports on a stored cost table

STORED_BY_SERVICE = """
    SELECT bill_billing_period_start_date AS billing_period, line_item_product_code AS service,
           SUM(line_item_unblended_cost) AS total_cost
    FROM {items}
    WHERE bill_billing_period_start_date = :period AND line_item_line_item_type NOT IN ('Credit', 'Refund')
    GROUP BY 1, 2 ORDER BY total_cost DESC, 1, 2 LIMIT 10
"""


def _stored_items(spark, folder, period: Column | None = None) -> DataFrame:
    """Cost items written in folders by billing period, registered and normalised."""
    columns = (*cost.cost_by_service.columns, *tagging.tagging_distribution.columns, PERIOD_COLUMN)
    items = cost_items(spark, folder, columns)
    if period is not None:
        items = items.withColumn(PERIOD_COLUMN, period)
    root = scratch_dir(spark, "stored-costs")
    # Few files per month, without a task that holds a whole one: a rebalance splits large months.
    items.hint("rebalance", PERIOD_COLUMN).write.partitionBy(PERIOD_COLUMN).parquet(f"{root}/cur_data")
    return normalise_costs(spark.table(register_table(spark, f"{root}/cur_data", **_database(spark, "billing"))))


def _stored_cost_by_service(spark, folder):
    return money_as_double(spark.sql(STORED_BY_SERVICE, args={"period": PERIOD}, items=_stored_items(spark, folder)))


def _stored_tagging_distribution(spark, folder):
    return money_as_double(tagging.tagging_distribution(_stored_items(spark, folder), TAG_KEY, period=PERIOD))


def _stored_current_period(spark, folder):
    """The default period: the months of the table moved so that one of them is the current one."""
    months = F.months_between(current_period(), F.lit(PERIOD)).cast("int")
    items = _stored_items(spark, folder, F.add_months(PERIOD_COLUMN, months))
    report = money_as_double(cost.cost_by_service(items, current_period()))
    return report.select("service", "total_cost")


# Ingest

ORDER_TYPES = ("bigint", "bigint", "string", "double", "date", "string")
ORDER_SCHEMA = (
    T.StructType()
    .add("o_orderkey", "long")
    .add("o_custkey", "long")
    .add("o_orderstatus", "string")
    .add("o_totalprice", "double")
    .add("o_orderdate", "timestamp")
    .add("o_orderpriority", "string")
)


def _orders_as_csv(spark, folder, where: str = "true", into: str | None = None) -> str:
    path = into or f"{scratch_dir(spark, 'orders-csv')}/input"
    write_csv(_table(spark, folder, "orders").where(where), path)
    return path


def _typed_orders(df: DataFrame) -> DataFrame:
    return ingest.apply_mapping(df, df.columns, ORDER_TYPES)


def _csv_roundtrip(spark, folder):
    source = _orders_as_csv(spark, folder)
    done = ingest.csv_to_parquet(spark, source, scratch_dir(spark, "parquet"), WHEN)
    return _typed_orders(spark.read.parquet(done.path))


def _schema_report(spark, folder):
    source = _orders_as_csv(spark, folder)
    done = ingest.csv_to_parquet(spark, source, scratch_dir(spark, "parquet"), WHEN)
    return schema_report(spark.read.parquet(done.path)).withColumn("records", F.lit(done.rows).cast("bigint"))


def _schema_changes(spark, folder):
    """Types found in all values of a CSV export against those of the table it came from."""
    found = infer_csv_schema(spark, _orders_as_csv(spark, folder))
    orders = _table(spark, folder, "orders").drop("o_orderstatus").withColumn("o_note", F.lit("none"))
    return schema_changes(spark, found, orders.schema)


def _misfit_rows(spark, folder):
    """Orders written next to lines of other tables: misfits are kept whole."""
    source = scratch_dir(spark, "mixed-csv")
    _orders_as_csv(spark, folder, into=f"{source}/orders")
    write_csv(_table(spark, folder, "customer"), f"{source}/customer")
    done = ingest.csv_to_parquet(
        spark, source, scratch_dir(spark, "parquet"), WHEN, ORDER_SCHEMA, corrupt_column=True
    )
    return spark.read.parquet(done.path).groupBy(F.col("_corrupt_record").isNotNull().alias("misfit")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").alias("key_sum")
    )


def _retyped_rows(spark, folder):
    source = _orders_as_csv(spark, folder)
    texts = spark.read.option("header", True).csv(source)
    typed = ingest.retype_strings(texts)
    return typed.withColumn("o_orderdate", F.to_date("o_orderdate"))


def _retyped_once(spark, folder):
    """The same rows from one scan of the export, written while the types are found."""
    texts = spark.read.option("header", True).csv(_orders_as_csv(spark, folder))
    typed = ingest.retype_once(texts, scratch_dir(spark, "retyped"))
    return typed.withColumn("o_orderdate", F.to_date("o_orderdate"))


def _database(spark, purpose: str) -> dict:
    location = scratch_dir(spark, purpose)
    return {"database": location.rsplit("/", 1)[-1].replace("-", "_"), "location": f"{location}/warehouse"}


def _registered_table(spark, folder):
    path = f"{scratch_dir(spark, 'partitioned')}/orders"
    _table(spark, folder, "orders").write.partitionBy("o_orderstatus").parquet(path)
    table = register_table(spark, path, prefix="cur_", **_database(spark, "registered"))
    return _typed_orders(spark.table(table).select(_table(spark, folder, "orders").columns))


def _evolved_table(spark, folder):
    """A table registered, then registered again after files with a new column came in."""
    path, database = f"{scratch_dir(spark, 'evolving')}/orders", _database(spark, "evolved")
    orders = _table(spark, folder, "orders")
    finished = F.col("o_orderstatus") == "F"
    orders.where(finished).drop("o_orderpriority").write.parquet(f"{path}/part=1")
    register_table(spark, path, prefix="cur_", **database)
    orders.where(~finished).write.parquet(f"{path}/part=2")
    table = register_table(spark, path, prefix="cur_", **database)
    return spark.table(table).select("o_orderkey", "o_orderstatus", "o_orderpriority", "part")


def _retyped_table(spark, folder):
    """A table whose later files have a price in whole units and a text key: one column, the wider type."""
    path, database = f"{scratch_dir(spark, 'retyping')}/orders", _database(spark, "retyped")
    orders = _table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    orders.where("o_orderstatus = 'F'").write.partitionBy("o_orderstatus").parquet(path)
    register_table(spark, path, **database)
    whole = F.floor("o_totalprice").cast("bigint").alias("o_totalprice")
    rest = orders.where("o_orderstatus <> 'F'")
    rest.select(F.concat(F.lit("o"), "o_orderkey").alias("o_orderkey"), whole, "o_orderstatus").write.partitionBy(
        "o_orderstatus"
    ).mode("append").parquet(path)
    table = register_table(spark, path, **database)
    return spark.table(table).select("o_orderkey", "o_totalprice", "o_orderstatus")


def _partition_changes(spark, folder):
    """What a listing finds against the catalog: registered with two priorities, then written anew with two others."""
    path, database = f"{scratch_dir(spark, 'partition-changes')}/orders", _database(spark, "changed")
    orders = _table(spark, folder, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).alias("rank"))
    orders.where("rank IN ('1', '2')").write.partitionBy("rank").parquet(path)
    table = register_table(spark, path, **database)
    orders.where("rank IN ('2', '3')").write.partitionBy("rank").mode("overwrite").parquet(path)
    changes = sync_partitions(spark, table, path, parquet_files(spark, path), drop=True)
    counted = spark.table(table).groupBy("rank").agg(F.count(F.lit(1)).alias("rows"))
    rank = F.regexp_extract("folder", "rank=(.*)", 1).cast("int").alias("rank")
    return counted.join(changes.select("change", rank), "rank", "full").select("rank", "change", "rows")


def _stream_ingest(spark, folder):
    """Two runs of the arrival stream into a table; the second reads only the files that came in between.

    The folders have a space and a plus sign in their names, which stay in `source_key`.
    """
    root, database = scratch_dir(spark, "arrivals"), _database(spark, "arrived")
    spark.sql(f"CREATE DATABASE {database['database']} LOCATION '{database['location']}'")
    for name, where in (("first run", "o_orderstatus = 'F'"), ("second+run", "o_orderstatus <> 'F'")):
        _orders_as_csv(spark, folder, where, f"{root}/input/{name}")
        arrivals = arriving_csv(spark, f"{root}/input", ORDER_SCHEMA)
        ingest_stream(
            arrivals, f"{root}/data", f"{root}/checkpoint", WHEN, database["database"], "raw_"
        ).awaitTermination()
    ingested = spark.table(f"{database['database']}.raw_data")
    orders = ingest.apply_mapping(
        ingested.drop("source_key", "dataset"), [*ORDER_SCHEMA.names, "run"], (*ORDER_TYPES, "int")
    )
    names = ingested.select(
        F.col("o_orderkey").alias("key"),
        F.regexp_extract("source_key", "/input/([^/]+)/", 1).alias("arrived_in"),
        (F.col("dataset") == dataset_name(F.col("source_key"), WHEN)).alias("named_after_file"),
    )
    return orders.join(names, F.col("o_orderkey") == F.col("key")).drop("key")


ORDERS_PER_FILE = 1000  # by order key


def _order_files(orders: DataFrame) -> DataFrame:
    """name and content of CSV files with a range of orders each."""
    line = F.to_csv(F.struct("o_orderkey", "o_orderstatus", "o_totalprice"))
    part = F.floor(F.col("o_orderkey") / ORDERS_PER_FILE).cast("string")
    files = orders.groupBy(F.concat(F.lit("orders_"), part, F.lit(".csv")).alias("name")).agg(F.collect_list(line).alias("lines"))
    header = F.lit("o_orderkey,o_orderstatus,o_totalprice\n")
    return files.select("name", F.concat(header, F.array_join("lines", "\n")).alias("content"))


def _bookmarked_orders(spark, folder):
    """Order files converted, the job run again, then once more with one new file and one written anew."""
    root, orders = scratch_dir(spark, "bookmarked"), _table(spark, folder, "orders")
    part = F.floor(F.col("o_orderkey") / ORDERS_PER_FILE)

    def put(rows: DataFrame, to: str, flat: bool) -> None:
        write_named_files(_order_files(rows), F.col("name"), F.col("content"), f"{root}/input/{to}", flat=flat)

    def run() -> int:
        schema = T.StructType().add("o_orderkey", "long").add("o_orderstatus", "string").add("o_totalprice", "double")
        return sum(r.files for r in convert_new(spark, f"{root}/input", bookmark, schema))

    bookmark = Bookmark(f"{root}/job")
    put(orders.where(part > 1), "many", False)
    put(orders.where(part == 0), "few", True)
    run()
    again = run()
    put(orders.where(part == 0).withColumn("o_totalprice", F.col("o_totalprice") + 1000), "few", True)
    put(orders.where(part == 1), "few", True)
    last = run()
    rows = bookmark.rows(spark).select("o_orderkey", "o_orderstatus", "o_totalprice")
    return rows.withColumns({"files_again": F.lit(again), "files_last": F.lit(last)})


def _converted_table(spark, folder):
    """A CSV export converted and registered in one job."""
    table = ingest.convert_and_register(
        spark, _orders_as_csv(spark, folder), scratch_dir(spark, "parquet"), WHEN, _database(spark, "converted")["database"]
    )
    return _typed_orders(spark.table(table))


def _sampled_rows(spark, folder):
    """The sample of a converted file: its size, and the rows that the table does not hold."""
    orders = _table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    sample = ingest.first_rows(orders)
    strange = sample.join(orders, ["o_orderkey", "o_custkey"], "left_anti")
    counted = sample.agg(F.count(F.lit(1)).alias("rows"))
    return counted.withColumn("strange", strange.agg(F.count(F.lit(1))).scalar())


def _refused_inputs(spark, folder):
    """Whether an input is refused for having no rows, for all orders and for none."""
    orders, found = _table(spark, folder, "orders"), []
    for name, df in (("all", orders), ("none", orders.where("o_orderkey IS NULL"))):
        try:
            ingest.require_rows(df, name)
            found.append((name, False))
        except ingest.EmptyInputError:
            found.append((name, True))
    return spark.createDataFrame(found, "input string, refused boolean")


PAGES_PER_FILE = 10


def _batch_files(spark, folder):
    """Files of ten pages each, written, listed, chosen by the marks in their names, and all rows read back."""
    path = scratch_dir(spark, "batches")
    part = F.floor(F.col("page_id") / PAGES_PER_FILE)
    kind = F.when(part % 3 == 0, "notes_").when(part % 5 == 0, "test_batch_").otherwise("data_batch_")
    line = F.to_json(F.struct("page_id", "url"))
    whole = _table(spark, folder, "pages").groupBy(F.concat(kind, part.cast("string"), F.lit(".json")).alias("name"))
    files = whole.agg(F.array_join(F.collect_list(line), "\n").alias("lines"))
    write_named_files(files, F.col("name"), F.col("lines"), path)
    listed = batch_files(read_directory(spark, path, "*.json"))
    rows = listed.select("split", F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line"))
    page = F.from_json("line", "page_id bigint, url string")
    return rows.select("split", page.alias("page")).select("page.page_id", "split", "page.url")


def _dataset_names(spark, folder):
    """Page addresses as encoded object keys, decoded again, with the data set each would make."""
    pages = _table(spark, folder, "pages").select("page_id", decoded_key(F.url_encode("url")).alias("key"))
    return pages.withColumn("dataset", dataset_name(F.col("key"), WHEN))


def _rendered_amounts(spark, folder):
    return _table(spark, folder, "customer").select(
        "c_custkey",
        two_decimals(F.col("c_acctbal")).alias("balance"),
        or_not_available(F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY"))).alias("segment"),
    )


def _usage_between_dates(spark, folder):
    """Events by day between two midnights: the second date counts only up to its start."""
    within = dates_between("ts", dt.date(2024, 1, 2), dt.date(2024, 1, 28))
    return (
        _table(spark, folder, "events")
        .where(within)
        .groupBy(F.to_date("ts").alias("usage_date"))
        .agg(F.count(F.lit(1)).alias("events"))
    )


# Pages


def _page_texts(spark, folder):
    return corpus.page_texts(_table(spark, folder, "pages"))


def _odd_page_texts(spark, folder):
    """Pages behind elements that close themselves or whose names only begin like removed ones."""
    before = '<title-bar>shop</title-bar><script src="x.js"/><head-line>x</head-line><style/><p>kept</p>'
    pages = _table(spark, folder, "pages")
    return corpus.page_texts(pages.withColumn("html", F.concat(F.lit(before), "html")))


def _pages_to_corpus(spark, folder):
    return corpus.pages_to_corpus(_table(spark, folder, "pages"), n=20)


def _page_sample(spark, folder):
    return sample_rows(_table(spark, folder, "pages").select("page_id", "url"), 100, "page_id", 42)


def _text_files(spark, folder):
    """A file per page, listed and read back as a table of files."""
    path = scratch_dir(spark, "texts")
    write_text_files(_page_texts(spark, folder), "page_id", "text", path)
    files = read_directory(spark, path, "*.txt")
    return files.select(
        F.regexp_extract("path", r"/file_(\d+)\.txt$", 1).cast("bigint").alias("page_id"),
        F.decode("content", "UTF-8").alias("text"),
    )


# Labels


def _label_rows(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("image_id"),
        F.floor(F.col("event_id") / RESPONSE_EVENTS).alias("response"),
        F.col("event_type").alias("tag"),
        F.col("value").alias("confidence"),
        F.col("event_id").alias("seq"),
    )


def _label_table(spark, folder):
    return money_as_double(labels.label_table(_label_rows(_table(spark, folder, "events"))))


def _responses(spark, folder) -> DataFrame:
    """Each embedding read as a detector response: one label per position."""
    found = F.transform(
        "embedding",
        lambda x, i: F.struct(
            F.concat(F.lit("label_"), i.cast("string")).alias("name"),
            (F.abs(x).cast("double") * 1000).alias("confidence"),
        ),
    )
    return _table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("image_id"), found.alias("labels"), F.col("vec_id").alias("seq")
    )


def _label_listing(spark, folder):
    return labels.label_listing(_responses(spark, folder))


def _response_items(spark, folder):
    return money_as_double(labels.response_items(_responses(spark, folder)))


def _event_files(spark, folder, name: str, part: Column, parts: int) -> DataFrame:
    """A stream of the events, written as a file for each number of `part`, that reads a file at a time."""
    events, source = _table(spark, folder, "events"), scratch_dir(spark, name)
    for i in range(parts):
        events.where(part == i).coalesce(1).write.mode("append").parquet(source)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)


UPSERT_BATCHES = 10


def _label_upsert_stream(spark, folder):
    """Events arriving in ten files, a batch each, with whole responses; an image comes in several."""
    last = _table(spark, folder, "events").agg(F.max("event_id")).first()[0] or 0
    part = F.floor(F.floor(F.col("event_id") / RESPONSE_EVENTS) * RESPONSE_EVENTS * UPSERT_BATCHES / (last + 1))
    arrivals = _event_files(spark, folder, "label-events", part, UPSERT_BATCHES)
    path = scratch_dir(spark, "labels")
    table = KeyedTable(f"{path}/table", labels.KEYS, "seq", buckets=8)
    upsert_stream(_label_rows(arrivals), table, f"{path}/checkpoint", labels.label_items).awaitTermination()
    return money_as_double(table.rows(spark))


def _label_state_stream(spark, folder):
    """Events arriving in three files, each with a third of every response: the same table as from whole ones."""
    arrivals = _event_files(spark, folder, "label-pieces", F.col("event_id") % 3, 3)
    path = scratch_dir(spark, "label-state")
    table = label_state_table(f"{path}/table", buckets=8)
    label_stream(_label_rows(arrivals), table, f"{path}/checkpoint").awaitTermination()
    return money_as_double(current_labels(spark, table))


def _label_lookup(spark, folder):
    """The labels of every tenth image from a stored table, of which only their buckets are read."""
    events = _table(spark, folder, "events")
    table = KeyedTable(f"{scratch_dir(spark, 'label-lookup')}/table", ("image_id",), "seq", buckets=32)
    table.put(_label_rows(events), 0)
    images = events.select(F.col("user_id").alias("image_id")).where("image_id % 10 = 0")
    return table.lookup(images).select("image_id", "tag", "confidence", "seq")


# Features


def _images(spark, folder) -> DataFrame:
    """Embeddings as 4 x 4 images with 4 channels of 0..255."""
    pixels = F.transform(
        "embedding", lambda x: (F.floor(F.abs(x.cast("double")) * 1000) % 256).cast("smallint")
    )
    return _table(spark, folder, "embeddings").select("vec_id", pixels.alias("pixels"), "label")


def _cells(df: DataFrame, array: str, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode(array).alias("position", "_cell")).select(
        *keys, "position", F.col("_cell").cast("double").alias("value")
    )


IMAGES_PER_FILE = 500


def _image_batches(spark, folder):
    """Images in pickled batch files of a fixed size, a test file after every four training files, read out of them."""

    def pickled(group: pd.DataFrame) -> pd.DataFrame:
        pixels = np.array(group["pixels"].tolist(), dtype="uint8")
        content = pickle.dumps({b"data": pixels, b"labels": [int(x) for x in group["label"]]})
        return pd.DataFrame({"name": [group["name"].iloc[0]], "content": [content]})

    path = scratch_dir(spark, "image-batches")
    part = F.floor(F.col("vec_id") / IMAGES_PER_FILE)
    name = F.concat(F.when(part % 5 == 4, "test_batch_").otherwise("data_batch_"), part.cast("string"))
    files = _images(spark, folder).withColumn("name", name).groupBy("name").applyInPandas(pickled, "name string, content binary")
    write_named_files(files, F.col("name"), F.col("content"), path)
    images = read_image_batches(spark, path)
    return images.select("split", "label", F.array_join(F.col("pixels").cast("array<string>"), ",").alias("pixels"))


def _prepare_images(spark, folder):
    return _cells(features.prepare_images(_images(spark, folder), SMALL_IMAGE), "pixels", "vec_id")


def _one_hot_labels(spark, folder):
    images = _images(spark, folder).select("vec_id", one_hot(F.col("label"), features.CLASSES).alias("label"))
    return _cells(images, "label", "vec_id")


def _augment_images(spark, folder):
    variants = features.augment_images(_images(spark, folder), "vec_id", 7, 2, SMALL_IMAGE, shift=0.25)
    return _cells(variants, "pixels", "vec_id", "copy", "flip", "dx", "dy")


def _array_shapes(spark, folder):
    split = train_test_split(_images(spark, folder), "vec_id")
    return features.array_shapes(features.prepare_images(split, SMALL_IMAGE))


def _appended_batches(spark, folder):
    split = train_test_split(_table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    return features.append_batches(split.where("split = 'train'"), split.where("split = 'test'"))


def _train_test_split(spark, folder):
    return train_test_split(_table(spark, folder, "orders").select("o_orderkey"), "o_orderkey")


def _split_counts(spark, folder):
    return split_counts(_train_test_split(spark, folder))


def _matrix_csv(spark, folder):
    path = scratch_dir(spark, "matrix")
    write_matrix(_measures(spark, folder), "features", path, 4)
    return spark.read.schema("f0 double, f1 double, f2 double, f3 double").csv(path)


# Models

MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
TRAINING_ROWS = 20_000  # labelled rows a model is fitted to
def _measures(spark, folder) -> DataFrame:
    """Four measures per line, with classes 0..2 by the discount and 0..1 by the tax.

    The classes follow from thresholds, so it is known what a model must learn.
    """
    discount = F.col("l_discount")
    return _table(spark, folder, "lineitem").select(
        "l_orderkey",
        F.array(*MEASURES).alias("features"),
        F.when(discount <= 0.03, 0).when(discount <= 0.06, 1).otherwise(2).alias("label"),
        (F.col("l_tax") > 0.04).cast("int").alias("is_taxed"),
    )


def _requests(spark, folder) -> DataFrame:
    """A JSON request per line, its four measures as a matrix of two rows."""
    data = F.array(F.array("l_quantity", "l_extendedprice"), F.array("l_discount", "l_tax"))
    body = F.to_json(F.struct(data.alias("data")))
    return _table(spark, folder, "lineitem").select("l_orderkey", body.alias("body"))


def _json_matrix(spark, folder):
    rows = _requests(spark, folder).select(
        "l_orderkey", F.posexplode(parse_matrix(F.col("body"))).alias("position", "row")
    )
    return rows.select("l_orderkey", "position", F.get("row", F.lit(0)).alias("x"), F.get("row", F.lit(1)).alias("y"))


def _trained(spark, folder) -> tuple[models.BoostedTrees, models.BoostedTrees, DataFrame]:
    """A model in the local setup, its copy that went through files, and the test part."""
    split = train_test_split(_measures(spark, folder), "l_orderkey")
    model = models.train_boosted_trees(split.where("split = 'train'"), 3, rows=TRAINING_ROWS)
    path = scratch_dir(spark, "model")
    model.save(spark, path)
    return model, models.load_model(spark, path, 3), split.where("split = 'test'")


def _boosted_trees_scores(spark, folder):
    _, model, test = _trained(spark, folder)
    total = F.aggregate("probabilities", F.lit(0.0), lambda a, p: a + p)
    return model.transform(test).select("l_orderkey", "label", "prediction", F.round(total, 9).alias("probability_sum"))


def _json_scores(spark, folder):
    _, model, test = _trained(spark, folder)
    body = F.to_json(F.struct(F.array("features").alias("data")))
    scored = models.score_requests(test.select("l_orderkey", body.alias("body")), model, "l_orderkey")
    return scored.withColumn("result", F.array_join(F.col("result").cast("array<string>"), ","))


def _model_metrics(spark, folder):
    """Metrics of the loaded model, and the rows whose scores differ from those before it was saved."""
    model, loaded, test = _trained(spark, folder)
    before = model.transform(test).drop("prediction").withColumnRenamed("probabilities", "before")
    both = loaded.transform(before).withColumn("differs", F.col("probabilities") != F.col("before"))
    differences = both.agg(F.count_if("differs").alias("differences"))
    metrics = models.evaluate(both).select("rows", "accuracy", (F.col("loss") < 0.2).alias("sure"))
    return metrics.withColumn("differences", differences.scalar())


def _evaluation(spark, folder):
    """The metrics of probabilities that follow from the discount, for an exact comparison."""
    lines = _table(spark, folder, "lineitem").select(
        (F.array_position(F.array(F.lit("A"), F.lit("N"), F.lit("R")), F.col("l_returnflag")) - 1).alias("label"),
        F.array(0.8 - F.col("l_discount"), 0.1 + F.col("l_discount"), F.lit(0.1)).alias("probabilities"),
        (F.col("l_linenumber") % 3).cast("double").alias("prediction"),
    )
    metrics = models.evaluate(lines)
    return metrics.select("rows", F.round("loss", 9).alias("loss"), F.round("accuracy", 9).alias("accuracy"))


def _rounded_predictions(spark, folder):
    halves = F.bround(F.col("l_quantity") / 2)
    return _table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", halves.alias("result"))


def _binary_model_metrics(spark, folder):
    """Metrics of the cloud setup."""
    split = train_test_split(_measures(spark, folder), "l_orderkey")
    train, test = split.where("split = 'train'"), split.where("split = 'test'")
    model = models.train_boosted_trees(train, 2, label="is_taxed", params=models.CLOUD_PARAMS, rows=TRAINING_ROWS)
    return models.evaluate(model.transform(test), "is_taxed").select("rows", "accuracy", (F.col("loss") < 0.2).alias("sure"))


def entry(spark: SparkSession) -> DataFrame:
    """Tagging distribution of one month over the smallest tables."""
    return queries()["tagging_distribution"](spark, "/root/testdata/sf0.001")


def _shipping(query: Query) -> Query:
    """The query, after the workers have got the package."""

    @functools.wraps(query)
    def run(spark, folder):
        session.ship_package(spark)
        return query(spark, folder)

    return run


def queries() -> dict[str, Query]:
    return {name: _shipping(query) for name, query in _queries().items()}


def _queries() -> dict[str, Query]:
    reports = {
        "cost_by_service": (cost.cost_by_service,),
        "cost_by_instance_type": (cost.cost_by_instance_type, SERVICE),
        "cost_by_resource_usage": (cost.cost_by_resource_usage, SERVICE),
        "daily_cost": (cost.daily_cost,),
        "cost_by_region": (cost.cost_by_region,),
        "reservation_costs": (cost.reservation_costs,),
        "savings_plan_utilization": (cost.savings_plan_utilization,),
        "usage_and_cost_by_operation": (cost.usage_and_cost_by_operation, SERVICE),
        "cost_by_tag": (tagging.cost_by_tag, TAG_KEY),
        "untagged_resources": (tagging.untagged_resources,),
        "tag_inventory": (tagging.tag_inventory,),
        "tagging_status_by_service": (tagging.tagging_status_by_service, TAG_KEY),
        "tagging_distribution": (tagging.tagging_distribution, TAG_KEY),
        "tagging_summary": (tagging.tagging_summary, TAG_KEY),
        "expensive_untagged": (tagging.expensive_untagged,),
    }
    detail = (tagging.service_resource_detail, SERVICE, TAG_KEY)
    return {
        **{name: _report(*call) for name, call in reports.items()},
        "service_resource_detail": _detail_with_text_tags(_report(*detail)),
        **{f"{name}_all_periods": _report_all(*call) for name, call in reports.items()},
        "service_resource_detail_all_periods": _detail_with_text_tags(_report_all(*detail)),
        "month_over_month": _month_over_month,
        "week_over_week": _week_over_week(
            trend.Weeks(dt.date(1998, 5, 11), dt.date(1998, 5, 17), dt.date(1998, 5, 4), dt.date(1998, 5, 10))
        ),
        "week_over_week_long_spans": _week_over_week(
            trend.Weeks(dt.date(1998, 7, 1), dt.date(2001, 12, 31), dt.date(1995, 1, 1), dt.date(1998, 6, 30))
        ),
        "stored_cost_by_service": _stored_cost_by_service,
        "stored_tagging_distribution": _stored_tagging_distribution,
        "stored_current_period": _stored_current_period,
        "monthly_report_distribution": _monthly_report("tagged_vs_untagged"),
        "monthly_report_expensive": _monthly_report("expensive_untagged"),
        "monthly_report_summary": _monthly_report("summary"),
        "csv_roundtrip": _csv_roundtrip,
        "misfit_rows": _misfit_rows,
        "schema_report": _schema_report,
        "schema_changes": _schema_changes,
        "retyped_rows": _retyped_rows,
        "retyped_once": _retyped_once,
        "registered_table": _registered_table,
        "evolved_table": _evolved_table,
        "retyped_table": _retyped_table,
        "partition_changes": _partition_changes,
        "stream_ingest": _stream_ingest,
        "converted_table": _converted_table,
        "bookmarked_orders": _bookmarked_orders,
        "sampled_rows": _sampled_rows,
        "refused_inputs": _refused_inputs,
        "batch_files": _batch_files,
        "dataset_names": _dataset_names,
        "rendered_amounts": _rendered_amounts,
        "usage_between_dates": _usage_between_dates,
        "page_texts": _page_texts,
        "odd_page_texts": _odd_page_texts,
        "pages_to_corpus": _pages_to_corpus,
        "page_sample": _page_sample,
        "text_files": _text_files,
        "label_table": _label_table,
        "label_listing": _label_listing,
        "response_items": _response_items,
        "label_upsert_stream": _label_upsert_stream,
        "label_state_stream": _label_state_stream,
        "label_lookup": _label_lookup,
        "image_batches": _image_batches,
        "prepare_images": _prepare_images,
        "one_hot_labels": _one_hot_labels,
        "augment_images": _augment_images,
        "array_shapes": _array_shapes,
        "appended_batches": _appended_batches,
        "train_test_split": _train_test_split,
        "split_counts": _split_counts,
        "matrix_csv": _matrix_csv,
        "json_matrix": _json_matrix,
        "rounded_predictions": _rounded_predictions,
        "evaluation": _evaluation,
        "boosted_trees_scores": _boosted_trees_scores,
        "json_scores": _json_scores,
        "model_metrics": _model_metrics,
        "binary_model_metrics": _binary_model_metrics,
        **({**llm_queries.QUERIES, "pipeline": corpus_pipeline.run} if llm_queries else {}),
    }


def oracle_sql() -> dict[str, str]:
    """SQL twins; none for the trained models, whose scores no other engine repeats."""
    return {**oracle_queries.all_queries(), **(llm_queries.ORACLE_SQL if llm_queries else {})}
