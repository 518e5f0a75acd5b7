"""Every registered query, over the whole of the tables in a folder.

The tables stand in for the layered data: ``events`` for landed rates, ``part`` for a code list with
attributes, ``customer`` for a dimension that changes, ``orders`` and ``lineitem`` for facts.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, TimestampNTZType

from siltstone.domains import exchange_rates as fx
from siltstone.functions import rules as R
from siltstone.functions import text as X
from siltstone.functions import values as V
from siltstone.operators import batches as B
from siltstone.operators import history as H
from siltstone.operators import incremental as I
from siltstone.operators import landing as L
from siltstone.operators import quality as Q
from siltstone.operators import star as S
from siltstone.operators import validation as VAL
from siltstone.plans import layers as P
from siltstone.sinks import tables as K
from siltstone.sinks.staging import stage, staging_path
from siltstone.sources import layers as SRC
from siltstone.streaming.landing import land_new_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    """Register a query; decimals leave it as their text, so that every digit is compared."""

    def spelled_out(spark: SparkSession, folder: str) -> DataFrame:
        df = build(spark, folder)
        return df.withColumns({c: V.column(c).cast("string") for c in VAL.columns_of_type(df, "decimal")})

    QUERIES[build.__name__] = spelled_out
    return build


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- rules -----------------------------------------------------------------------------------

def _rule(df: DataFrame, keys: list[str], name: str, rules: dict, check_format: bool = False) -> DataFrame:
    errors = R.error_column(name, rules, df.schema[name].dataType, check_format)
    return df.select(*keys, errors.alias("errors"))


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their label, NULL where there is none."""
    documents = table(spark, folder, "documents").select("doc_id")
    return documents.join(table(spark, folder, "labels"), "doc_id", "left")


@query
def rule_required(spark, folder):
    return _rule(_labelled(spark, folder), ["doc_id"], "quality", {"required": True})


@query
def rule_min(spark, folder):
    return _rule(table(spark, folder, "supplier"), ["s_suppkey"], "s_acctbal", {"min": 0})


@query
def rule_max(spark, folder):
    return _rule(table(spark, folder, "part"), ["p_partkey"], "p_size", {"max": 45})


@query
def rule_min_date(spark, folder):
    return _rule(table(spark, folder, "orders"), ["o_orderkey"], "o_orderdate", {"min_date": "1998-01-01"})


@query
def rule_max_rate(spark, folder):
    return _rule(table(spark, folder, "events"), ["event_id"], "value", {"max_rate_value": 100})


@query
def rule_min_rate(spark, folder):
    lines = table(spark, folder, "lineitem")
    return _rule(lines, ["l_orderkey", "l_linenumber", "l_partkey"], "l_tax", {"min_rate_value": 0.000001})


@query
def rule_length(spark, folder):
    return _rule(table(spark, folder, "part"), ["p_partkey"], "p_name", {"length": 9})


@query
def rule_format(spark, folder):
    return _rule(table(spark, folder, "part"), ["p_partkey"], "p_brand", {"format": "Brand#[0-9]"}, True)


@query
def rule_type(spark, folder):
    """Columns landed as text, some with text that is not of the declared type, read and checked row by row."""
    parts = table(spark, folder, "part")
    odd = F.pmod(F.col("p_partkey"), F.lit(7))
    landed = parts.select(
        "p_partkey",
        F.when(odd == 0, F.concat("p_name", F.lit("?"))).otherwise(F.col("p_size").cast("string")).alias("size"),
        F.when(odd == 1, F.lit(" ")).when(odd == 2, F.lit("n/a")).otherwise(F.col("p_retailprice").cast("string")).alias("price"),
        F.when(odd == 3, F.lit("maybe")).otherwise((F.col("p_size") > 25).cast("string")).alias("large"),
    )
    rules = {
        "size": {"type": "integer", "required": True, "max": 45},
        "price": {"type": "decimal", "required": False, "min_rate_value": 1000},
        "large": {"type": "boolean", "required": False},
    }
    checked = VAL.validate(VAL.cast_types(landed, rules), rules)
    text = lambda c: F.col(c).cast("string").alias(c)
    return checked.select("p_partkey", text("size"), "price", text("large"), F.col(VAL.ERRORS).alias("errors"))


@query
def rule_combined(spark, folder):
    rules = {"required": True, "min": 10, "max": 5, "max_rate_value": 30}
    return _rule(table(spark, folder, "part"), ["p_partkey"], "p_size", rules)


@query
def rule_accumulated(spark, folder):
    orders = table(spark, folder, "orders")
    first = VAL.validate(orders, {"o_totalprice": {"min": 100000, "max": 400000}, "o_absent": {"required": True}})
    second = VAL.validate(
        first, {"o_orderpriority": {"length": 6}, "o_orderdate": {"min_date": "1996-06-01"}}, ["o_orderdate", "o_orderpriority"]
    )
    return second.select("o_orderkey", F.col(VAL.ERRORS).alias("errors"))


# --- quarantine ------------------------------------------------------------------------------

_LINE_RULES = {
    "l_quantity": {"required": True, "min": 5, "max": 45},
    "l_discount": {"max_rate_value": 0.09},
    "l_shipdate": {"min_date": "1996-01-01"},
    "l_returnflag": {"required": True, "length": 1},
}


def _checked_lines(spark: SparkSession, folder: str) -> DataFrame:
    return VAL.validate(table(spark, folder, "lineitem"), _LINE_RULES)


@query
def quarantine_valid(spark, folder):
    return VAL.split_quarantine(_checked_lines(spark, folder))[0]


@query
def quarantine_rejected(spark, folder):
    return VAL.split_quarantine(_checked_lines(spark, folder))[1].withColumnRenamed(VAL.ERRORS, "errors")


@query
def quarantine_counts(spark, folder):
    return VAL.quarantine_counts(_checked_lines(spark, folder))


@query
def quarantine_written(spark, folder):
    """Both sinks fed by one evaluation, read back and counted per batch."""
    lines = _checked_lines(spark, folder).withColumn("_batch_id", F.date_format("l_shipdate", "yyyy"))
    valid, rejected = staging_path(spark, "valid"), staging_path(spark, "rejected")
    K.write_split(lines, valid, rejected, ["l_returnflag"], ["l_orderkey", "l_linenumber"])
    batch = F.col("_batch_id").cast("string").alias("batch")
    kept = spark.read.parquet(valid).select(batch, F.lit("valid").alias("verdict"))
    out = spark.read.parquet(rejected).select(batch, F.lit("rejected").alias("verdict"))
    return kept.unionByName(out).groupBy("batch", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query
def quarantine_rerun(spark, folder):
    """A batch run again replaces its rejected rows: fewer the second time, and none for a year that is clean by then."""
    lines = table(spark, folder, "lineitem").withColumn("_batch_id", F.date_format("l_shipdate", "yyyy"))
    valid, rejected = staging_path(spark, "valid"), staging_path(spark, "rejected")
    K.write_split(VAL.validate(lines, {"l_quantity": {"max": 45}}), valid, rejected)
    mended = lines.filter("l_shipdate >= TIMESTAMP_NTZ '1996-01-01'").withColumn(
        "l_quantity", F.when(F.col("_batch_id") == "1996", 1).otherwise(F.col("l_quantity") - 2))
    K.write_split(VAL.validate(mended, {"l_quantity": {"max": 45}}), valid, rejected)
    out = spark.read.parquet(rejected).select(F.col("_batch_id").cast("string").alias("batch"), "l_orderkey", "l_linenumber", "l_quantity")
    return out


# --- cleaning --------------------------------------------------------------------------------

def _lines_of_text(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


@query
def blank_to_null(spark, folder):
    return VAL.blank_strings_to_null(_lines_of_text(spark, folder), ["line"])


@query
def code_lpad(spark, folder):
    code = F.col("c_custkey").cast("string")
    return table(spark, folder, "customer").select(
        "c_custkey", X.pad_code(code, truncate=True).alias("code"), X.pad_code(code).alias("code_whole")
    )


@query
def clean_fields(spark, folder):
    """Short values: the lines of all documents."""
    return VAL.clean_strings(_lines_of_text(spark, folder), ["line"])


@query
def clean_text_full(spark, folder):
    """Long values: whole documents, pages and turns."""
    documents = table(spark, folder, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("bigint").alias("part"), "text")
    pages = table(spark, folder, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.lit(0).cast("bigint").alias("part"), F.col("html").alias("text"))
    turns = table(spark, folder, "conversations").select(F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), F.col("turn").alias("part"), "text")
    return VAL.clean_strings(documents.unionByName(pages).unionByName(turns), ["text"])


# --- landing ---------------------------------------------------------------------------------

@query
def payload_explode(spark, folder):
    events = table(spark, folder, "events").select("event_id", F.from_json("props", "map<string,string>").alias("props"))
    return L.explode_map(events, "props", "code", "rate")


def _payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Events as rate payloads; errors carry the empty list some payloads have in place of a map."""
    events = table(spark, folder, "events")
    rates = F.when(F.col("event_type") == "error", F.lit("[]")).otherwise(F.col("props"))
    text = F.concat(
        F.lit('{"response":{"date":"'), F.date_format("ts", V.PAYLOAD_TIME_FORMAT),
        F.lit('","base":"'), F.col("event_type"), F.lit('","rates":'), rates, F.lit("}}"),
    )
    return events.select("event_id", text.alias("payload"))


@query
def payload_empty_guard(spark, folder):
    return L.split_corrupt(L.land_map_payload(_payloads(spark, folder), "payload", ntz=True))[0]


@query
def payload_corrupt(spark, folder):
    """Payloads cut short, without a map, and with a number or a date that is none: every one leaves a row."""
    events = table(spark, folder, "events")
    kind = F.col("event_type")
    rates = (
        F.when(kind == "error", F.lit('"oops"')).when(kind == "signup", F.lit('{"k": "n/a"}')).when(kind == "view", F.lit("[]"))
        .otherwise(F.col("props")))
    date = F.when(kind == "click", F.lit("soon")).otherwise(F.date_format("ts", V.PAYLOAD_WALL_FORMAT))
    end = F.when(kind == "purchase", F.lit("")).otherwise(F.lit("}}"))
    text = F.concat(F.lit('{"response":{"date":"'), date, F.lit('","base":"'), kind, F.lit('","rates":'), rates, end)
    landed = L.land_map_payload(events.select("event_id", text.alias("payload")), "payload", ntz=True)
    return landed.withColumnRenamed(L.CORRUPT, "corrupt")


@query
def payload_rescued(spark, folder):
    """Error messages, empty texts, empty codes and fields nobody named: all documents leave rows, and say what they held."""
    events = table(spark, folder, "events")
    kind, date = F.col("event_type"), F.date_format("ts", V.PAYLOAD_WALL_FORMAT)
    body = lambda rates, more="", top="": F.concat(
        F.lit('{"response":{"date":"'), date, F.lit('","base":"'), kind, F.lit('","rates":'), rates, F.lit(f"{more}}}{top}}}"))
    text = (
        F.when(kind == "error", F.lit('{"error":"quota"}'))
        .when(kind == "signup", body(F.lit('{"":2.5}')))
        .when(kind == "view", F.when(F.col("user_id") % 2 == 0, F.lit("")).otherwise(body(F.lit("null"))))
        .when(kind == "click", body(F.col("props"), ',"note":"late"', ',"meta":7'))
        .otherwise(body(F.col("props"))))
    landed = L.land_map_payload(events.select("event_id", text.alias("payload")), "payload", ntz=True, rescue=True)
    return landed.withColumnsRenamed({L.CORRUPT: "corrupt", L.RESCUED: "rescued"})


@query
def records_rescued(spark, folder):
    """Lists of records with a field that the schema does not name, and documents without a list."""
    orders = table(spark, folder, "orders")
    listed = F.struct(F.array(F.struct(F.col("o_orderstatus").alias("name"), F.col("o_custkey").alias("extra"))).alias("response"))
    text = F.when(F.col("o_orderstatus") == "P", F.lit('{"error":"quota"}')).when(F.col("o_orderstatus") == "O", F.lit('{"response":[]}')).otherwise(F.to_json(listed))
    payloads = orders.select("o_orderkey", text.alias("payload"))
    landed = L.explode_records(payloads, "payload", StructType().add("name", "string"), rescue=True)
    return landed.withColumnsRenamed({L.CORRUPT: "corrupt", L.RESCUED: "rescued"})


@query
def payload_records(spark, folder):
    """A record list per order: its status and its priority."""
    orders = table(spark, folder, "orders")
    record = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("name"))
    listed = F.struct(F.array(record("status", "o_orderstatus"), record("priority", "o_orderpriority")).alias("response"))
    payloads = orders.select("o_orderkey", F.to_json(listed).alias("payload"))
    return L.explode_records(payloads, "payload", StructType().add("kind", "string").add("name", "string")).drop(L.CORRUPT)


@query
def payload_files(spark, folder):
    """Record lists landed from files."""
    orders, path = table(spark, folder, "orders"), staging_path(spark, "payloads")
    record = lambda kind, c: F.struct("o_orderkey", F.lit(kind).alias("kind"), F.col(c).alias("name"))
    listed = F.array(record("status", "o_orderstatus"), record("priority", "o_orderpriority")).alias("response")
    orders.select(listed).write.json(path)
    schema = StructType().add("o_orderkey", "long").add("kind", "string").add("name", "string")
    return L.land_records(spark, path, schema).drop(L.CORRUPT)


@query
def payload_files_streamed(spark, folder):
    """Rate payloads picked up by the landing stream, which ends when it has caught up."""
    arrived, landed, progress = (staging_path(spark, name) for name in ("arrived", "landed", "progress"))
    _payloads(spark, folder).select("payload").write.text(arrived)
    columns = ["curr_base", "currency", "rate", "rate_date"]
    land_new_files(spark, arrived, landed, progress, lambda df: L.land_map_payload(df, "payload", ntz=True), columns).awaitTermination()
    return spark.read.parquet(landed).select(*columns)


@query
def add_lineage(spark, folder):
    events = table(spark, folder, "events")
    day = V.truncate_time(F.col("ts"), "day", TimestampNTZType())
    return L.add_lineage(events.select("event_id", "ts"), "events", day).drop("ts")


@query
def parse_timestamp(spark, folder):
    events = table(spark, folder, "events")
    text = F.date_format("ts", V.PAYLOAD_TIME_FORMAT)
    return events.select("event_id", text.alias("text")).withColumn("parsed", V.parse_time(F.col("text"), ntz=True))


@query
def decimal_exact(spark, folder):
    lines = table(spark, folder, "lineitem")
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        V.exact_decimal(F.col("l_extendedprice")).alias("price"), V.exact_decimal(F.col("l_discount")).alias("discount"),
    )


# --- batches and reference lists -------------------------------------------------------------

@query
def landed_run_latest(spark, folder):
    """Two runs landed into one table, of which the later is read: all its rows, and no others."""
    events, path = table(spark, folder, "events"), staging_path(spark, "landed")
    middle = F.lit(_CUTOFF).cast("timestamp_ntz")
    for run, at in ((events.filter(F.col("ts") < middle), "2024-02-01 06:00:00"), (events.filter(F.col("ts") >= middle), "2024-02-02 06:00:00")):
        landed = L.add_lineage(run.select("event_id", "event_type", "user_id"), "events", F.lit(at).cast("timestamp_ntz"))
        K.write_layer(landed, path, "append", ["_batch_id"])
    return B.latest_batch(spark.read.parquet(path)).withColumn("_batch_id", F.col("_batch_id").cast("string"))


@query
def latest_batch(spark, folder):
    events = table(spark, folder, "events")
    batched = events.withColumn("_ingested_at", V.truncate_time(F.col("ts"), "day", TimestampNTZType()))
    return B.latest_batch(batched)


@query
def dedupe_by_key(spark, folder):
    lines = table(spark, folder, "lineitem")
    return B.dedupe_by_key(lines, ["l_orderkey", "l_linenumber"], [F.col("l_shipdate").desc_nulls_last()])


@query
def known_semi_join(spark, folder):
    customers = table(spark, folder, "customer").filter(F.col("c_acctbal") > 0)
    return B.keep_known(table(spark, folder, "orders"), customers, {"o_custkey": "c_custkey"})


@query
def known_semi_join_both(spark, folder):
    codes = table(spark, folder, "part").filter(F.col("p_size") >= 10)
    lines = table(spark, folder, "lineitem")
    return B.keep_known(lines, codes, {"l_suppkey": "p_partkey", "l_partkey": "p_partkey"})


# --- dimensions and facts --------------------------------------------------------------------

_CUTOFF = "2024-01-20 12:00:00"


def _staged_rates(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_type").alias("curr_base"),
        F.col("user_id").cast("string").alias("currency"),
        V.exact_decimal(F.col("value")).alias("rate"),
        F.col("ts").alias("rate_date"),
    )


def _loaded_before(rates: DataFrame) -> DataFrame:
    """What earlier runs saw: up to the cutoff, and without errors, which then arrive late."""
    return rates.filter((F.col("rate_date") < F.lit(_CUTOFF).cast("timestamp_ntz")) & (F.col("curr_base") != "error"))


def _star(rates: DataFrame, previous: P.Star | None = None, **options) -> P.Star:
    return P.build_star(rates, "rate_date", list(fx.FACT_KEY), ["rate"], previous, **options)


def _stored(star: P.Star) -> P.Star:
    """A star as an earlier run left it: in tables."""
    return P.Star(stage(star.dim_date, "dim-date"), stage(star.fact, "fact"))


@query
def dim_date_full(spark, folder):
    return I.date_dimension(_staged_rates(spark, folder), "rate_date")


@query
def dim_date_incremental(spark, folder):
    rates = _staged_rates(spark, folder)
    before = stage(I.date_dimension(_loaded_before(rates), "rate_date"), "dim-date")
    return I.incremental_date_dimension(rates, "rate_date", before)


@query
def fact_full(spark, folder):
    return _star(_staged_rates(spark, folder)).fact


@query
def fact_full_every_row(spark, folder):
    """Without reducing rates of one pair in one minute to the later one."""
    return _star(_staged_rates(spark, folder), strict=False).fact


@query
def fact_incremental(spark, folder):
    rates = _staged_rates(spark, folder)
    return _star(rates, _stored(_star(_loaded_before(rates)))).fact


@query
def fact_late_rows(spark, folder):
    """The second load looks back as far as rows were late, and so ends with every fact."""
    rates = _staged_rates(spark, folder)
    span = rates.agg(F.max("rate_date") - F.min("rate_date")).first()[0] or timedelta(0)
    return _star(rates, _stored(_star(_loaded_before(rates))), lookback=span + timedelta(minutes=1)).fact


@query
def fact_full_refresh(spark, folder):
    """A refresh forgets what earlier runs loaded."""
    rates = _staged_rates(spark, folder)
    late = rates.filter(F.col("rate_date") >= F.lit(_CUTOFF).cast("timestamp_ntz"))
    return _star(late, _stored(_star(_loaded_before(rates))), full_refresh=True).fact


@query
def empty_target_incremental(spark, folder):
    rates = _staged_rates(spark, folder)
    return _star(rates, _stored(_star(rates.filter(F.col("curr_base") == "none")))).fact


@query
def star_loaded(spark, folder):
    """Two loads into stored tables, the second touching only the days after the cutoff."""
    rates = _staged_rates(spark, folder)
    dims, facts = staging_path(spark, "dim-date"), staging_path(spark, "fact")
    star = None
    for batch in (_loaded_before(rates), rates):
        star = P.load_star(spark, batch, dims, facts, "rate_date", fx.FACT_KEY, ["rate"])
    return S.read_fact(star.fact, star.dim_date)


@query
def star_loaded_empty_first(spark, folder):
    """A first load without rows, then one with all: the star is whole."""
    rates = _staged_rates(spark, folder)
    dims, facts = staging_path(spark, "dim-date"), staging_path(spark, "fact")
    star = None
    for batch in (rates.filter("false"), rates):
        star = P.load_star(spark, batch, dims, facts, "rate_date", fx.FACT_KEY, ["rate"])
    return star.fact


@query
def fact_by_ledger(spark, folder):
    """Three batches that all cross the same days, loaded out of order, then everything landed once more: nothing is too late, and nothing
    is loaded twice."""
    rates = table(spark, folder, "events").select(
        F.col("event_type").alias("curr_base"), F.col("user_id").cast("string").alias("currency"), V.exact_decimal(F.col("value")).alias("rate"),
        F.col("ts").alias("rate_date"), F.concat(F.lit("b"), F.pmod("event_id", F.lit(3))).alias("_batch_id"))
    dims, facts, ledger = (staging_path(spark, name) for name in ("dim-date", "fact", "ledger"))
    star = None
    for names in (["b2"], ["b0"], ["b0", "b1"], ["b0", "b1", "b2"]):
        landed = rates.filter(F.col("_batch_id").isin(names))
        star = P.load_batches(spark, landed, dims, facts, ledger, "rate_date", fx.FACT_KEY, ["rate"])
    return star.fact


@query
def upsert_moved(spark, folder):
    """An upsert whose partition does not follow from the key: rows leave the partition they are stored in for another."""
    lines, path = table(spark, folder, "lineitem"), staging_path(spark, "lines")
    key = ["l_orderkey", "l_linenumber"]
    later = [F.col("l_shipdate").desc_nulls_last()]
    K.write_layer(B.dedupe_by_key(lines, key, later), path, partition_by=["l_returnflag"], sort_by=key)
    returned = B.dedupe_by_key(lines.filter(F.col("l_linenumber") == 2), key, later).withColumn("l_returnflag", F.lit("X"))
    K.upsert_partitions(spark, path, returned, key, "l_returnflag", moving=True)
    return spark.read.schema(lines.schema).parquet(path).select(lines.columns)


@query
def upsert_delete_insert(spark, folder):
    lines = table(spark, folder, "lineitem")
    key = ["l_orderkey", "l_linenumber"]
    later = [F.col("l_shipdate").desc_nulls_last()]
    target = B.dedupe_by_key(lines.filter(F.col("l_returnflag") != "R"), key, later)
    return I.upsert_delete_insert(target, lines.filter(F.col("l_returnflag") == "R"), key, order_by=later)


@query
def upsert_partitions(spark, folder):
    """The upsert as a sink: only the days that the new rows fall on are rewritten."""
    facts = table(spark, folder, "events").select(
        F.date_format("ts", "yyyyMMdd").cast("int").alias("day"), V.date_key(F.col("ts")).alias("date_key"), "event_type", "user_id", "value", "event_id"
    )
    key = ["date_key", "event_type", "user_id"]
    later = [F.col("event_id").desc_nulls_last()]
    path = staging_path(spark, "fact")
    K.write_layer(B.dedupe_by_key(facts, key, later), path, partition_by=["day"], sort_by=["date_key"])
    corrected = facts.filter(F.col("day") >= 20240121).withColumn("value", F.lit(0.0))
    K.upsert_partitions(spark, path, corrected, key, "day", order_by=later)
    return spark.read.parquet(path)


# --- history ---------------------------------------------------------------------------------

_FIRST, _SECOND = "1997-01-01", "1999-06-01"
_CUSTOMER_CHECKS = ["c_name", "c_nationkey", "c_mktsegment"]


def _customers_later(customers: DataFrame) -> DataFrame:
    """Some segments renamed, one nation gone, others in twice under a new key, all balances changed."""
    changed = customers.filter(F.col("c_nationkey") != 3).withColumns({
        "c_mktsegment": F.when(F.col("c_mktsegment") == "MACHINERY", "TOOLS").otherwise(F.col("c_mktsegment")),
        "c_acctbal": F.col("c_acctbal") + 1,
    })
    added = customers.filter(F.col("c_nationkey") == 7).withColumn("c_custkey", F.col("c_custkey") + 1000000000)
    return changed.unionByName(added)


def _history(spark: SparkSession, folder: str, at: tuple[str, str] = (_FIRST, _SECOND), **options) -> DataFrame:
    customers = table(spark, folder, "customer")
    take = lambda target, source, at, **o: H.scd2_snapshot(
        target, source, "c_custkey", _CUSTOMER_CHECKS, at, time_type=TimestampNTZType(), **o
    )
    first = take(None, customers, at[0])
    return take(first, _customers_later(customers), at[1], **options)


@query
def scd2_snapshot(spark, folder):
    return _history(spark, folder)


@query
def scd2_stored(spark, folder):
    """Both snapshots, and a repetition of the second, taken into a stored history."""
    customers, path = table(spark, folder, "customer"), staging_path(spark, "history")
    later = _customers_later(customers)
    for source, at in ((customers, _FIRST), (later, _SECOND), (later, _SECOND)):
        history = K.save_snapshot(spark, path, source, "c_custkey", _CUSTOMER_CHECKS, at, time_type=TimestampNTZType())
    return history


@query
def scd2_hard_deletes(spark, folder):
    return _history(spark, folder, hard_deletes="invalidate")


@query
def scd2_rerun(spark, folder):
    """The same snapshot taken again, later: nothing changes."""
    again = _customers_later(table(spark, folder, "customer"))
    return H.scd2_snapshot(_history(spark, folder), again, "c_custkey", _CUSTOMER_CHECKS, "2000-01-01")


@query
def scd2_dim(spark, folder):
    return H.scd2_dimension(
        _history(spark, folder), {"customer_key": "c_custkey", "name": "c_name", "segment": "c_mktsegment"}
    )


_ON_CUSTOMER = {"o_custkey": "c_custkey"}


def _asof(joined: DataFrame) -> DataFrame:
    return joined.select("o_orderkey", "o_custkey", "o_orderdate", "c_mktsegment", "valid_from", "valid_to")


@query
def scd2_asof_closed(spark, folder):
    return _asof(H.asof_dim_join(table(spark, folder, "orders"), _history(spark, folder), _ON_CUSTOMER, "o_orderdate", "both"))


@query
def scd2_asof_halfopen(spark, folder):
    return _asof(H.asof_dim_join(table(spark, folder, "orders"), _history(spark, folder), _ON_CUSTOMER, "o_orderdate"))


def _order_states(spark: SparkSession, folder: str) -> DataFrame:
    """Each customer's latest order as a slowly changing state: many versions per key."""
    return table(spark, folder, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus", F.col("o_orderdate").alias("seen_at"))


@query
def scd2_replay(spark, folder):
    return H.scd2_replay(_order_states(spark, folder), "o_custkey", ["o_orderpriority", "o_orderstatus"], "seen_at")


def _monthly_states(spark: SparkSession, folder: str) -> DataFrame:
    """Customers in the months they ordered in: most vanish from most batches."""
    month = V.truncate_time(F.col("o_orderdate"), "month", TimestampNTZType())
    return table(spark, folder, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus", month.alias("seen_at"))


@query
def scd2_replay_deletes(spark, folder):
    return H.scd2_replay_deletes(_monthly_states(spark, folder), "o_custkey", ["o_orderpriority", "o_orderstatus"], "seen_at")


def _three_batches(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Customers as seen on three days; one segment is renamed and back, nations are missing."""
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    renamed = F.when(F.col("c_mktsegment") == "BUILDING", "HOUSES").otherwise(F.col("c_mktsegment"))
    return {
        "1996-01-01": customers.filter("c_nationkey <> 4"),
        "1997-01-01": customers.filter("c_nationkey NOT IN (3, 4)").withColumn("c_mktsegment", renamed),
        "1998-01-01": customers.filter("c_nationkey <> 5"),
    }


@query
def scd2_backdated(spark, folder):
    """Three snapshots taken out of order give the history of the sorted order."""
    batches, history, seen = _three_batches(spark, folder), None, []
    checks = ["c_nationkey", "c_mktsegment"]
    for at in ("1998-01-01", "1996-01-01", "1997-01-01"):
        taken = spark.createDataFrame([(t,) for t in seen], "at string")
        if history is None:
            history = H.scd2_snapshot(None, batches[at], "c_custkey", checks, at, time_type=TimestampNTZType())
        else:
            history = stage(H.scd2_splice(history, taken, batches[at], "c_custkey", checks, at, "invalidate"), "history")
        seen.append(at)
    return history


@query
def scd2_stored_backdated(spark, folder):
    """The same into a stored history, which keeps the moments it has seen."""
    batches, path, taken = _three_batches(spark, folder), staging_path(spark, "history"), staging_path(spark, "taken")
    for at in ("1997-01-01", "1998-01-01", "1996-01-01", "1997-01-01"):
        history = K.splice_snapshot(
            spark, path, taken, batches[at], "c_custkey", ["c_nationkey", "c_mktsegment"], at, "invalidate", TimestampNTZType())
    return history


@query
def scd2_stored_deletes(spark, folder):
    """Stored snapshots that close what vanished: some customers first, then all of them."""
    path, customers = staging_path(spark, "history"), table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    for source, at in ((customers, _FIRST), (customers.filter("c_custkey % 3 > 0"), _SECOND), (customers.filter("false"), "2000-01-01")):
        history = K.save_snapshot(spark, path, source, "c_custkey", ["c_name"], at, time_type=TimestampNTZType(), hard_deletes="invalidate")
    return history


def _asof_long(spark: SparkSession, folder: str, closed: str) -> DataFrame:
    """Order dates of customers looked up in the long history of the same customers' states."""
    states = stage(scd2_replay(spark, folder).withColumnRenamed("o_custkey", "key"), "states")
    facts = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return H.asof_merge_join(facts, states, {"o_custkey": "key"}, "o_orderdate", closed).drop("key")


@query
def scd2_asof_merge(spark, folder):
    return _asof_long(spark, folder, "half")


@query
def scd2_asof_merge_closed(spark, folder):
    return _asof_long(spark, folder, "both")


@query
def scd2_asof_chosen(spark, folder):
    """The way of joining picked by the length of the histories; here they are short."""
    return _asof(H.asof_join(table(spark, folder, "orders"), _history(spark, folder), _ON_CUSTOMER, "o_orderdate"))


@query
def surrogate_key(spark, folder):
    return _history(spark, folder).select(
        "c_custkey", "valid_from", V.surrogate_key("c_custkey", "valid_from").alias("customer_sk"),
        V.surrogate_key("c_custkey", "valid_to").alias("closing_sk"),
    )


@query
def resolve_surrogate(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return H.resolve_surrogate(orders, _history(spark, folder), _ON_CUSTOMER, "o_orderdate", "customer_sk")


@query
def asof_two_roles(spark, folder):
    """One history in two roles: lines with the versions of two codes valid when they shipped."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    history = _history(spark, folder)
    return S.asof_star_join(
        lines, "l_shipdate",
        S.AsOfRole(history, {"l_suppkey": "c_custkey"}, {"seller_segment": "c_mktsegment", "seller_from": "valid_from"}),
        S.AsOfRole(history, {"l_partkey": "c_custkey"}, {"buyer_segment": "c_mktsegment"}),
    )


@query
def fact_with_surrogates(spark, folder):
    """A stored fact, loaded twice, with the surrogate keys of both its codes' versions."""
    rates = table(spark, folder, "events").select(
        F.col("event_id").alias("curr_base"), F.col("user_id").alias("currency"), V.exact_decimal(F.col("value")).alias("rate"), F.col("ts").alias("rate_date"))
    history = stage(_history(spark, folder, ("2023-01-01", _CUTOFF)), "history")
    roles = [S.AsOfRole(history, {c: "c_custkey"}, {}, f"{c}_sk") for c in ("curr_base", "currency")]
    dims, facts = staging_path(spark, "dim-date"), staging_path(spark, "fact")
    early = rates.filter(F.col("rate_date") < F.lit(_CUTOFF).cast("timestamp_ntz"))
    for batch in (early, rates):
        star = P.load_star(spark, batch, dims, facts, "rate_date", fx.FACT_KEY, ["rate"], histories=roles)
    return star.fact


# --- star ------------------------------------------------------------------------------------

@query
def fact_readback(spark, folder):
    star = _star(_staged_rates(spark, folder))
    return S.read_fact(star.fact, star.dim_date)


@query
def fact_topn(spark, folder):
    return S.preview(_star(_staged_rates(spark, folder)).fact, 100)


@query
def role_playing_dims(spark, folder):
    """Lines with the nation in its two roles, as seller's and as buyer's, each resolved before it meets the lines."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    nations = table(spark, folder, "nation")
    sellers = S.star_join(table(spark, folder, "supplier"), S.Role(nations, "s_nationkey", "n_nationkey", {"seller": "n_name"}))
    buyers = S.star_join(table(spark, folder, "customer"), S.Role(nations, "c_nationkey", "n_nationkey", {"buyer": "n_name"}))
    orders = S.star_join(table(spark, folder, "orders"), S.Role(buyers, "o_custkey", "c_custkey", {"buyer": "buyer"}))
    return S.star_join(
        lines,
        S.Role(orders, "l_orderkey", "o_orderkey", {"buyer": "buyer"}),
        S.Role(sellers, "l_suppkey", "s_suppkey", {"seller": "seller"}),
    ).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "buyer", "seller")


# --- quality ---------------------------------------------------------------------------------

@query
def dq_not_null(spark, folder):
    return Q.dq_not_null(_labelled(spark, folder), ["quality", "toxic"]).select("doc_id")


@query
def dq_unique(spark, folder):
    return Q.dq_unique(table(spark, folder, "lineitem"), "l_orderkey")


@query
def dq_primary_key(spark, folder):
    return Q.dq_primary_key(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


def _sound_customers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").filter(F.col("c_acctbal") > 0)


@query
def dq_relationships(spark, folder):
    return Q.dq_relationships(table(spark, folder, "orders"), "o_custkey", _sound_customers(spark, folder), "c_custkey")


@query
def dq_foreign_key(spark, folder):
    return Q.dq_foreign_key(table(spark, folder, "orders"), "o_custkey", _sound_customers(spark, folder), "c_custkey")


@query
def dq_suite(spark, folder):
    tables = {
        "labelled": _labelled(spark, folder),
        "lineitem": table(spark, folder, "lineitem"),
        "orders": table(spark, folder, "orders"),
        "customer": table(spark, folder, "customer"),
        "sound_customer": _sound_customers(spark, folder),
    }
    return Q.dq_suite(tables, [
        Q.Check("not_null", "labelled", ("doc_id", "quality", "toxic")),
        Q.Check("not_null", "orders", "o_custkey"),
        Q.Check("unique", "orders", "o_orderkey"),
        Q.Check("unique", "lineitem", "l_orderkey"),
        Q.Check("primary_key", "lineitem", ("l_orderkey", "l_linenumber")),
        Q.Check("foreign_key", "lineitem", "l_orderkey", "orders", "o_orderkey"),
        Q.Check("relationships", "orders", "o_custkey", "customer", "c_custkey"),
        Q.Check("relationships", "orders", "o_custkey", "sound_customer", "c_custkey"),
    ])


@query
def dq_incremental(spark, folder):
    """A primary key checked after each of two loads by stored counts: what the second report and the first one's untouched keys say together."""
    lines, path = table(spark, folder, "lineitem"), staging_path(spark, "key-counts")
    key = ["l_orderkey", "l_linenumber"]
    first = K.count_keys(spark, path, lines.filter("l_returnflag = 'R'"), key)
    second = K.count_keys(spark, path, lines.filter("l_returnflag <> 'R' OR l_returnflag IS NULL"), key)
    untouched = first.join(second, key, "left_anti")
    broken = (F.col("n_records") > 1) | F.col("l_orderkey").isNull() | F.col("l_linenumber").isNull()
    return second.unionByName(untouched).filter(broken)


@query
def dq_incremental_references(spark, folder):
    """References of one load checked against the stored key counts of their parent."""
    parents, children = staging_path(spark, "parent-counts"), staging_path(spark, "child-counts")
    K.count_keys(spark, parents, _sound_customers(spark, folder), ["c_custkey"])
    met = K.count_keys(spark, children, table(spark, folder, "orders"), ["o_custkey"])
    return K.unknown_keys(met, ["o_custkey"], spark.read.parquet(parents), ["c_custkey"])


@query
def dq_star(spark, folder):
    """Every check that the domain declares, on stored tables made from currencies and rates: valid rows, history, star."""
    currencies = stage(P.silver_dimension(_currencies(spark, folder), fx.CURRENCIES_RULES, ["code"])[0], "currencies")
    landed = _landed_rates(spark, folder)
    rates = stage(landed[0], "rates")
    history = H.scd2_snapshot(
        None, B.dedupe_by_key(currencies, [fx.CURRENCY_KEY]), fx.CURRENCY_KEY, list(fx.CURRENCY_CHECK_COLS), _FIRST, time_type=TimestampNTZType())
    dim = stage(H.scd2_dimension(history, fx.DIM_CURRENCIES), "dim")
    star = _stored(_star(rates))
    return Q.dq_suite(
        {"currencies": currencies, "rates": rates, "dim_currencies": dim, "dim_date": star.dim_date, "fact_rates": star.fact}, fx.CHECKS)


# --- layers ----------------------------------------------------------------------------------

@query
def layer_overwritten(spark, folder):
    """A small table kept as one file, written twice: the second run replaces the first."""
    path = staging_path(spark, "suppliers")
    suppliers = table(spark, folder, "supplier")
    for part in (suppliers, suppliers.filter("s_acctbal > 0")):
        K.write_layer(part, path, "overwrite", rebalance=True)
    return spark.read.parquet(path)


@query
def layer_roundtrip(spark, folder):
    lines = table(spark, folder, "lineitem")
    path = staging_path(spark, "lines")
    K.write_layer(lines, path, "append", ["l_returnflag"])
    return SRC.read_layer(spark, path, schema=lines.schema).select(lines.columns)


@query
def layer_counts(spark, folder):
    """Counts observed by the write itself."""
    lines, seen = K.layer_counts(table(spark, folder, "lineitem"), "written", largest=F.max("l_orderkey"))
    K.write_layer(lines, staging_path(spark, "lines"), partition_by=["l_returnflag"])
    return spark.createDataFrame([(seen.get["rows"], seen.get["largest"])], "n_rows bigint, largest bigint")


@query
def read_optional(spark, folder):
    orders = table(spark, folder, "orders")
    return orders.unionByName(SRC.read_optional(spark, f"{folder}/absent_quarantine.parquet", orders.schema))


def _table_name(spark: SparkSession, name: str) -> tuple[str, str]:
    path = staging_path(spark, name)
    return "siltstone_" + path.rsplit("/", 1)[1].replace("-", "_"), path


def _unnamed(spark: SparkSession, name: str, df: DataFrame) -> DataFrame:
    """A frame of a table's files, whose name is dropped from the catalogue; the files stay."""
    spark.sql(f"DROP TABLE {name}")
    return df


@query
def materialize_table(spark, folder):
    name, path = _table_name(spark, "dim")
    customers = scd2_dim(spark, folder)
    K.materialize_table(customers, name, path)
    built = K.materialize_table(customers.filter("is_current"), name, path)
    return _unnamed(spark, name, spark.read.schema(built.schema).parquet(path))


@query
def load_stage(spark, folder):
    """Replace the rows of a table that already exists with a definition of its own."""
    name, path = _table_name(spark, "stage")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    definition = StructType.fromDDL("o_custkey bigint, o_orderkey bigint, o_totalprice double")
    spark.catalog.createTable(name, path=path, source="parquet", schema=definition)
    K.load_stage(orders.filter(F.col("o_totalprice") < 100000), name)
    K.load_stage(orders, name)
    return _unnamed(spark, name, spark.read.schema(spark.table(name).schema).parquet(path))


@query
def register_layer(spark, folder):
    name, _ = _table_name(spark, "external")
    lines = table(spark, folder, "lineitem")
    SRC.register_layer(spark, name, f"{folder}/lineitem.parquet", lines.schema)
    counted = spark.sql(f"SELECT l_returnflag, l_linestatus, count(*) AS n FROM {name} GROUP BY ALL")
    return _unnamed(spark, name, stage(counted, "counted"))


# --- recipes ---------------------------------------------------------------------------------

def _currencies(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").cast("int").alias("id"),
        F.col("p_name").alias("name"),
        (F.col("p_partkey") % 1200).cast("string").alias("short_code"),
        F.col("p_size").cast("string").alias("code"),
        F.length("p_brand").cast("int").alias("precision"),
        F.floor("p_retailprice").cast("int").alias("subunit"),
        F.col("p_brand").alias("symbol"),
        (F.col("p_size") > 25).alias("symbol_first"),
        (F.col("p_size") % 12).cast("string").alias("decimal_mark"),
        F.when(F.col("p_size") > 10, (F.col("p_size") % 11).cast("string")).alias("thousands_separator"),
    ).withColumn("precision", F.col("precision") - 6)


@query
def silver_dimension_valid(spark, folder):
    return P.silver_dimension(_currencies(spark, folder), fx.CURRENCIES_RULES, ["code"])[0]


@query
def silver_dimension_rejected(spark, folder):
    return P.silver_dimension(_currencies(spark, folder), fx.CURRENCIES_RULES, ["code"])[1].select("id", F.col(VAL.ERRORS).alias("errors"))


def _landed_rates(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Valid and rejected rates between codes of the currencies and some that they lack."""
    rates = table(spark, folder, "events").select(
        F.pmod("event_id", F.lit(1200)).cast("string").alias("curr_base"), F.pmod("user_id", F.lit(1300)).cast("string").alias("currency"),
        V.exact_decimal(F.col("value")).alias("rate"), V.truncate_time(F.col("ts"), "hour", TimestampNTZType()).alias("rate_date"),
        V.truncate_time(F.col("ts"), "year", TimestampNTZType()).alias("_ingested_at"))
    codes = rates.select(F.col("curr_base").alias("short_code")).unionByName(rates.select(F.col("currency").alias("short_code"))).distinct()
    return P.silver_fact(rates, codes, {"curr_base": "short_code", "currency": "short_code"}, fx.RATES_RULES, fx.RATES_KEY)


def _silver_rates(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, folder, "events")
    rates = events.select(
        (F.length("event_type") + 99 - F.pmod(F.col("event_id"), F.lit(7))).cast("string").alias("curr_base"),
        F.col("user_id").cast("string").alias("currency"),
        V.exact_decimal(F.col("value") - 1).alias("rate"),
        V.truncate_time(F.col("ts"), "hour", TimestampNTZType()).alias("rate_date"),
        V.truncate_time(F.col("ts"), "month", TimestampNTZType()).alias("_ingested_at"),
    )
    bases = rates.select(F.col("curr_base").alias("short_code")).filter(F.col("short_code") != "101").distinct()
    codes = table(spark, folder, "customer").filter(F.col("c_acctbal") > 0).select(F.col("c_custkey").cast("string").alias("short_code"))
    known = {"curr_base": "short_code", "currency": "short_code"}
    return P.silver_fact(rates, bases.unionByName(codes), known, fx.RATES_RULES, fx.RATES_KEY)


@query
def silver_fact_valid(spark, folder):
    return _silver_rates(spark, folder)[0]


@query
def silver_fact_rejected(spark, folder):
    return _silver_rates(spark, folder)[1].withColumnRenamed(VAL.ERRORS, "errors")


@query
def events_star(spark, folder):
    """Events all the way: lineage, cleaning, rules, split, one row per key and minute, star, read back."""
    events = table(spark, folder, "events")
    landed = L.add_lineage(events, "events", V.truncate_time(F.col("ts"), "day", TimestampNTZType()))
    checked = VAL.validate(VAL.clean_strings(landed, ["event_type"]), {
        "value": {"required": True, "min": 1, "max": 300},
        "ts": {"required": True, "min_date": "2024-01-01"},
        "event_type": {"required": True},
    })
    valid = stage(VAL.split_quarantine(checked)[0], "silver")
    star = P.build_star(valid, "ts", ["event_type", "user_id"], ["value"])
    return S.read_fact(star.fact, star.dim_date)
