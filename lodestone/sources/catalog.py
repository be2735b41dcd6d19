"""Reading catalogs and sessions, and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_strings = T.ArrayType(T.StringType())
_entries = T.ArrayType(T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.StringType())]))

PRODUCT = T.StructType(
    [
        T.StructField("parent_asin", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("features", _strings),
        T.StructField("description", _strings),
        T.StructField("price", T.DoubleType()),
        T.StructField("categories", _strings),
        T.StructField("average_rating", T.DoubleType()),
        T.StructField("rating_number", T.LongType()),
        T.StructField("store", T.StringType()),
    ]
)
SAMPLE = (
    "sample_id string, scenario_type string, category_bucket string, difficulty_bucket string, "
    "user_profile struct<purchase_frequency:string,average_prior_rating:double,rating_style:string,preference_tags:array<string>,summary:string>, "
    "ground_truth struct<parent_asin:string>, "
    "intent_card struct<target_category:string,hard_constraints:array<string>,soft_preferences:array<string>>, "
    "behavior struct<scenario_type:string,override:struct<turn:int,old_value:string,new_value:string,message:string>>"
)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, value): the lines of text files and their order. A row's number is its partition's and its place there; order is by
    file and offset, and only order matters."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    # ids rise within a split; splits are put in the order of files and blocks
    return lines.select(F.struct("file", "block", "at").alias("ord"), "value").filter(F.trim("value") != "")


def _details(value):
    """The entries of a JSON object in the order in which they stand, values as text."""
    obj = F.get_json_object(value, "$.details")
    names = F.json_object_keys(obj)
    return F.transform(names, lambda k: F.struct(k.alias("k"), F.variant_get(F.parse_json(obj), F.lit("$"), "map<string,string>")[k].alias("v")))


def parse_products(lines: DataFrame) -> DataFrame:
    """(ord, ok, product fields, details): lines that are no JSON object have ok false."""
    parsed = lines.withColumn("p", F.from_json("value", PRODUCT, {"mode": "PERMISSIVE"}))
    ok = F.try_parse_json("value").isNotNull() & F.col("value").rlike(r"^\s*\{")
    return parsed.select("ord", "value", ok.alias("ok"), "p.*", F.when(ok, _details(F.col("value"))).alias("details"))


def fail_on_bad_lines(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """ValueError with file and line number of the first line that holds no JSON object. rows: what parse_products gives."""
    bad = rows.filter(~F.col("ok")).orderBy("ord").select("ord", "value").first()
    if bad is None:
        return
    # lines are counted only when one is bad: those of its file before it
    lines = spark.read.text(path).select(F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).alias("ord"))
    at = F.struct(*[F.lit(bad["ord"][c]).alias(c) for c in ("file", "block", "at")])
    number = lines.filter((F.col("ord.file") == bad["ord"]["file"]) & (F.col("ord") <= at)).count()
    raise ValueError(f"no JSON object in {bad['ord']['file']} at line {number}: {bad['value'][:80]!r}")


def _one_per_id(rows: DataFrame, last: bool) -> DataFrame:
    order = F.desc("ord") if last else F.asc("ord")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("parent_asin").orderBy(order))).filter("_n = 1").drop("_n")


def read_catalog(spark: SparkSession, path: str, policy: str = "tolerant") -> DataFrame:
    """A catalog of JSON lines, one row per product, with ord, the order of its lines.

    policy: "tolerant" skips bad lines and those without an id and keeps the first of an id; "first" fails on bad lines and
    keeps the first; "last" fails on bad lines and missing ids and keeps the last; "strict" fails on repeated ids too.
    """
    rows = parse_products(numbered_lines(spark, path))
    no_id = F.col("parent_asin").isNull() | (F.trim("parent_asin") == "")
    if policy == "tolerant":
        rows = rows.filter(F.col("ok") & ~no_id)
    elif policy in ("first", "last", "strict"):
        fail_on_bad_lines(spark, path, rows)
        if policy == "first":
            rows = rows.filter(~no_id)
        elif not rows.filter(no_id).isEmpty():
            raise ValueError("a product has no parent_asin")
        if policy == "strict":
            twice = rows.groupBy("parent_asin").count().filter("count > 1").limit(1).collect()
            if twice:
                raise ValueError(f"Duplicate parent_asin {twice[0]['parent_asin']}")
    else:
        raise ValueError(f"unknown policy {policy!r}")
    return _one_per_id(rows.drop("ok", "value"), last=policy == "last")


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SAMPLE).json(path)


def target_titles(catalog: DataFrame, targets: DataFrame) -> DataFrame:
    """(parent_asin, title) of the targets only; a target that the catalog lacks fails."""
    if not targets.join(catalog, "parent_asin", "left_anti").isEmpty():
        raise ValueError("a target is not in the catalog")
    return catalog.select("parent_asin", "title").join(targets, "parent_asin", "left_semi")


def relabelled(rows: DataFrame, column: str, keep: list[str], prefix: str) -> DataFrame:
    """Rows of a stored result with some labels, marked as old (once)."""
    label = F.col(column)
    return rows.filter(label.isin(keep) | label.isin([prefix + k for k in keep])).withColumn(column, F.when(label.startswith(prefix), label).otherwise(F.concat(F.lit(prefix), label)))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """What write_csv wrote: columns by the header of each file, as text."""
    return spark.read.option("header", True).option("multiLine", True).csv(path)


def kept_runs(spark: SparkSession, path: str, mode: str = "llm_on", prefix: str = "historical_", mark: str = "historical; not rerun") -> DataFrame | None:
    """Earlier rows of a result at path (with columns mode and available) that a run without connection cannot make again: those of the mode that
    were available, marked as old. None if there is no such result."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return None
    rows = read_csv(spark, path).filter(F.col("mode").contains(mode) & F.col("available").isin("yes", mark))
    return rows.withColumn("mode", F.when(F.col("mode").startswith(prefix), F.col("mode")).otherwise(F.concat(F.lit(prefix), "mode"))).withColumn("available", F.lit(mark))


def write_csv(df: DataFrame, path: str, columns: list[str], append: bool = False) -> None:
    """CSV files in a folder, each with its header, so that an append is a file more and read_csv needs no care."""
    df.select(*columns).write.mode("append" if append else "errorifexists").option("header", True).option("lineSep", "\n").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def markdown_table(df: DataFrame, digits: int = 6, most_rows: int = 1000) -> str:
    """A small result as a Markdown table; one of more than most_rows rows fails."""
    rows = df.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"more than {most_rows} rows")
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in rows]) + "\n"


def robustness_report(levels: DataFrame, scenarios: DataFrame, examples: DataFrame, failures: DataFrame, costs: DataFrame | None = None) -> str:
    """A report on reworded messages, as Markdown: metrics by level, by level and scenario, examples before and after, why sessions got worse, and costs if they are known."""
    parts = [("Levels", levels.orderBy("level")), ("Scenarios", scenarios.orderBy("level", "scenario_type")), ("Examples", examples), ("Failures", failures.groupBy("level", "reason").count().orderBy("level", F.desc("count"), "reason"))]
    if costs is not None:
        parts.append(("Costs", costs))
    base = levels.filter("level = 0").first()
    head = ["# Robustness against other wording", ""]
    if base is not None:
        head += [f"Without rewording: {', '.join(f'{c} {base[c]:.6f}' for c in levels.columns if isinstance(base[c], float))}.", ""]
    for title, rows in parts:
        head += [f"## {title}", "", markdown_table(rows)]
    return "\n".join(head)
