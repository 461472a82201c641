"""Reading tables and rules, writing redacted tables and audit lines."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskmill.functions.rules import BUILTIN, Policy, Rule, custom_rules

RULES_SCHEMA = "rule_id int, name string, origin string, kind string, pattern string, replacement string, anchors array<string>, anchor_ci boolean, audit boolean, ord int"
RULE_SPEC = "type string, value string, name string"
#: A rule file or table is configuration: more rules than this are refused.
MAX_RULES = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one in local mode (tests)
    and ValueError on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='maskmill-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Rows of a task that works on each of them for long: a task's share stays as it is when a table grows.
TASK_ROWS = 50_000


def spread(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """A table dealt over tasks of about TASK_ROWS rows, and over all cores, before heavy work on each row: by keys, so that a join or
    a grouping by them needs no other shuffle, else evenly. Its rows are counted if they are not given; of a table of files
    that reads no columns."""
    n = -(-(df.count() if rows is None else rows) // TASK_ROWS)
    return df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism), *keys)


def rules_table(spark: SparkSession, rules: tuple[Rule, ...] = BUILTIN) -> DataFrame:
    """The rules as rows, ord giving the fold order."""
    kind = {((1, 2, 3), (5,)): "keep_assign", ((1,), ()): "keep_g1", ((1,), (3,)): "keep_g1_g3"}
    rows = [(i + 1, r.name, r.origin, "exact" if r.literal else "regex", r.literal or r.pattern, kind.get((r.before, r.after), "full"), list(r.anchors), r.anchor_ci, r.audit, i) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, RULES_SCHEMA)


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """(type, value, name, ord) of a rules file: JSON (a list, or one rule a line) or YAML in block style (- type: .. / value: .. /
    name: ..), told apart by its ending. Files that Spark's file systems reach; the order of the file is the rules' order."""
    if not path.endswith((".yaml", ".yml")):
        return spark.read.schema(RULE_SPEC).option("multiLine", not path.endswith(".jsonl")).json(path).withColumn("ord", F.monotonically_increasing_id())
    text = spark.read.text(path, wholetext=True)
    items = text.select(F.posexplode(F.filter(F.split("value", r"(?m)^\s*-\s+"), lambda x: F.rlike(x, F.lit(r"(?m)^\s*type\s*:")))).alias("ord", "item"))
    field = lambda name: F.nullif(F.regexp_replace(F.trim(F.regexp_extract("item", rf"(?m)^\s*{name}\s*:[ \t]*(.*?)\s*$", 1)), r"""^(["'])(.*)\1$""", "$2"), F.lit(""))
    return items.select(field("type").alias("type"), field("value").alias("value"), field("name").alias("name"), F.col("ord").cast("long").alias("ord"))


def policy_of(rules: DataFrame, **how) -> Policy:
    """A policy with the rules of a table; refused above MAX_RULES."""
    rows = rules.orderBy("ord").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    return Policy(rules=custom_rules([r.asDict() for r in rows]), **how)


def write_redacted(df: DataFrame, path: str, **options) -> None:
    """A new table; the original is never changed in place."""
    df.write.mode("errorifexists").options(**options).parquet(path)


def audit_lines(events: DataFrame) -> DataFrame:
    """One JSON line for each audit event."""
    return events.where("redactions > 0").select(F.to_json(F.struct("ts", "event", "path", "redactions", "rules")).alias("value"))


def write_audit(events: DataFrame, path: str) -> None:
    audit_lines(events).write.mode("append").text(path)


def stream_table(spark: SparkSession, sf_dir: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """The same table as a stream of its files, be it one file or a folder of them: as a pattern, the path may be either."""
    schema = schema or table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.[p]arquet")
