"""Readers and writers: CSV pairs, report JSON/CSV, JSONL logs, match files, keyed tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.plans.checkpoints import drop_stable, stable

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on its own file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def transaction_schema(block: int = 339) -> T.StructType:
    """The card-transaction table: keys and counts as numbers, categories as text, all nullable."""
    num, txt = T.DoubleType(), T.StringType()
    fields = [("TransactionID", T.LongType()), ("isFraud", T.IntegerType()), ("TransactionDT", T.LongType()), ("TransactionAmt", num), ("ProductCD", txt)]
    fields += [(f"card{i}", txt if i in (4, 6) else num) for i in range(1, 7)] + [("addr1", num), ("addr2", num), ("dist1", num), ("dist2", num)]
    fields += [("P_emaildomain", txt), ("R_emaildomain", txt)] + [(f"C{i}", num) for i in range(1, 15)] + [(f"D{i}", num) for i in range(1, 16)]
    fields += [(f"M{i}", txt) for i in range(1, 10)] + [(f"V{i}", num) for i in range(1, block + 1)]
    return T.StructType([T.StructField(n, t) for n, t in fields])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Headed CSV. Without a schema the types are inferred, which reads the file twice."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_pair(spark: SparkSession, folder: str, fact_schema=None, identity_schema=None, split: str = "train") -> tuple[DataFrame, DataFrame] | None:
    """(transactions, identity) of a split; None when an optional split is absent."""
    paths = [f"{folder}/{split}_{part}.csv" for part in ("transaction", "identity")]
    if not all(exists(spark, p) for p in paths):
        if split == "train":
            raise FileNotFoundError(f"no training pair in {folder}")
        return None
    return read_csv(spark, paths[0], fact_schema), read_csv(spark, paths[1], identity_schema)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


read_report_csv = read_csv

# One schema for the writer and the reader of the weekly report.
STATUS_RECORD = "value:double,threshold:double,drifted_features:array<string>,details:map<string,double>"
METHOD_RECORD = ("method:string,raw_flag:boolean,confirmed_flag:boolean,model_version:bigint,confirmation_state:array<boolean>,reason:string,metrics:map<string,double>,"
                 f"status:struct<{STATUS_RECORD}>")
RETRAIN_RECORD = "method:string,from_version:bigint,to_version:bigint,retrain_count:int"
FEATURE_RECORD = "feature:string,rank:int,metrics:map<string,double>,flags:map<string,boolean>"
WEEKLY_RECORD = (f"array<struct<week:int,is_baseline:boolean,rows:bigint,overall_drift_flag:boolean,top_features:array<string>,methods:array<struct<{METHOD_RECORD}>>,"
                 f"feature_metrics:array<struct<{FEATURE_RECORD}>>,retrains:array<struct<{RETRAIN_RECORD}>>>>")


def _fields(record: str) -> list[str]:
    """Names of the fields of a record, at its top level."""
    depth, names, name, reading = 0, [], "", True
    for ch in record + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            names, name, reading = [*names, name], "", True
        elif ch == ":" and depth == 0:
            reading = False
        elif reading:
            name += ch
    return names


def _listed(df: DataFrame, record: str, name: str, order: str) -> DataFrame:
    """(week, name): the rows of each week as an array of ``record``, ordered by a field; a field that ``df`` lacks is null."""
    types = {f.name: f.dataType for f in T._parse_datatype_string(record).fields}
    cells = [(F.col(c) if c in df.columns else F.lit(None)).cast(types[c]).alias(c) for c in _fields(record)]
    # Maps have no order to sort by: one field decides.
    ordered = F.array_sort("_l", lambda x, y: F.when(x[order] < y[order], -1).when(x[order] > y[order], 1).otherwise(0))
    return df.groupBy("week").agg(F.collect_list(F.struct(*cells)).alias("_l")).select("week", ordered.alias(name))


def write_report_json(matrix: DataFrame, path: str, top: dict | None = None, mode: str = "overwrite", *, rows: DataFrame | None = None, triggers: DataFrame | None = None,
                      retrains: DataFrame | None = None, status: DataFrame | None = None, features: DataFrame | None = None, baseline: int = 0) -> None:
    """One nested document: weekly records with their methods and features. The matrix has one row per (week, method).

    ``rows`` is (week, rows) of all weeks, also of those without methods such as the baseline; ``triggers`` is
    (week, method, reason, metrics) as streams.explain_trigger gives it; ``retrains`` is (week, method, from_version,
    to_version, retrain_count), see policies.adopt; ``status`` is (week, method, value, threshold, drifted_features, details), the numbers a
    method's flag rests on, by feature where it has them; ``features`` is (week, feature, rank, metrics, flags) of the monitored features, best
    first. A matrix column ``confirmation_state`` holds the flags that the confirmation looked at. What is not given stays null or empty.
    """
    told = matrix
    if triggers is not None:
        told = told.join(triggers.select("week", "method", "reason", "metrics"), ["week", "method"], "left")
    if status is not None:
        held = status.select("week", "method", F.struct(*_fields(STATUS_RECORD)).alias("status"))
        told = told.join(held, ["week", "method"], "left")
    weeks = _listed(told, METHOD_RECORD, "methods", "method").join(matrix.groupBy("week").agg(F.bool_or("confirmed_flag").alias("overall_drift_flag")), "week")
    for table, record, name, order in ((retrains, RETRAIN_RECORD, "retrains", "method"), (features, FEATURE_RECORD, "feature_metrics", "rank")):
        weeks = weeks.join(_listed(table, record, name, order), "week", "full") if table is not None else weeks.withColumn(name, F.lit(None).cast(f"array<struct<{record}>>"))
    weeks = weeks.join(rows.select("week", "rows"), "week", "full") if rows is not None else weeks.withColumn("rows", F.lit(None).cast("bigint"))
    names = F.transform("feature_metrics", lambda f: f["feature"])
    lists = [F.coalesce(c, F.array().cast(weeks.schema[c].dataType)).alias(c) for c in ("methods", "feature_metrics", "retrains")]
    record = F.struct(F.col("week").cast("int").alias("week"), (F.col("week") == baseline).alias("is_baseline"), F.col("rows").cast("bigint").alias("rows"), "overall_drift_flag",
                      F.coalesce(names, F.array().cast("array<string>")).alias("top_features"), *lists)
    one = weeks.agg(F.collect_list(record).alias("_r"))
    ordered = F.array_sort("_r", lambda x, y: x["week"] - y["week"])
    cells = [F.lit(v).alias(k) for k, v in (top or {}).items()]
    document = F.to_json(F.struct(*cells, ordered.alias("weekly_records")))
    one.select(document.alias("value")).write.mode(mode).text(path)


def _weeks(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(f"weekly_records {WEEKLY_RECORD}").option("multiLine", True).json(path)
    return raw.select(F.explode("weekly_records").alias("w")).select("w.*")


def read_report_records(spark: SparkSession, path: str) -> DataFrame:
    """All of a nested weekly report but its features: a row per (week, method), and one with null methods for a week that has none."""
    weeks = _weeks(spark, path).select("week", "is_baseline", "rows", "overall_drift_flag", "top_features", "retrains", F.explode_outer("methods").alias("m"))
    own = F.get(F.filter("retrains", lambda x: x["method"] == F.col("m.method")), F.lit(0))
    plain = weeks.select("week", "is_baseline", "rows", "overall_drift_flag", "top_features", "m.*", *[own[c].alias(c) for c in ("from_version", "to_version", "retrain_count")])
    return plain.select(*[c for c in plain.columns if c != "status"], *[F.col(f"status.{c}").alias(c) for c in _fields(STATUS_RECORD)])


def read_report_features(spark: SparkSession, path: str) -> DataFrame:
    """(week, feature, rank, metrics, flags) of a nested weekly report."""
    return _weeks(spark, path).select("week", F.explode("feature_metrics").alias("f")).select("week", "f.*")


def read_report_json(spark: SparkSession, path: str) -> DataFrame:
    """(week, method, flags, version) rows of a nested weekly report."""
    records = read_report_records(spark, path).filter(~F.coalesce("is_baseline", F.lit(False)) & F.col("method").isNotNull())
    return records.select("week", "method", "raw_flag", "confirmed_flag", "model_version")


def append_application_log(records: DataFrame, path: str) -> None:
    """Append application records as JSON lines."""
    records.write.mode("append").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


MATCH_SCHEMA = ("job struct<portal:string,job_id:string,title:string,company:string,location:string,url:string,description:string,posted:string,scraped_at:string>,"
                "portal string, job_id string, title string, company string, location string, url string, description string, posted string, scraped_at string,"
                "score int, reasoning string, skill_overlap array<string>, gaps array<string>, recommended boolean")


def read_matches_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of matches, each nested under ``job`` or flat; see listings.import_matches."""
    return spark.read.schema(MATCH_SCHEMA).option("multiLine", True).json(path)


def export_matches(ranked: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Ranked results as JSON lines, best first (range-partitioned, so files are in order)."""
    ranked.orderBy(F.desc("match_score"), "id").write.mode(mode).json(path)


METRICS = ("loss", "grad_norm", "learning_rate", "entropy", "num_tokens", "mean_token_accuracy", "eval_loss", "eval_runtime", "eval_samples_per_second", "eval_steps_per_second", "eval_entropy", "eval_num_tokens", "eval_mean_token_accuracy", "train_loss", "train_runtime")


def read_trainer_log(spark: SparkSession, path: str, metrics: Sequence[str] = METRICS) -> DataFrame:
    """log_history entries of a trainer state file as (step, epoch, metric, value), for the named metrics; the file is read once."""
    fields = ", ".join(["step: double", "epoch: double", *[f"`{m}`: double" for m in metrics]])
    raw = spark.read.schema(f"log_history array<struct<{fields}>>").option("multiLine", True).json(path)
    rows = raw.select(F.explode("log_history").alias("h")).select("h.*").withColumn("step", F.col("step").cast("int"))
    return rows.unpivot(["step", "epoch"], list(metrics), "metric", "value").filter(F.col("value").isNotNull())


BUCKET = "_bucket"


class BucketedTable:
    """A keyed table as plain Parquet, partitioned by a hash bucket of the key.

    A merge reads and replaces only the buckets that its batch touches, by Spark's dynamic partition overwrite; the rest of the table is
    neither read nor written. One writer at a time. A reader that has started may have to start again when its bucket is replaced.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "id", buckets: int = 16):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def _placed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _stored(self, schema: T.StructType | str | None = None) -> DataFrame:
        known = None if schema is None else self._placed(self.spark.createDataFrame([], schema))
        if not exists(self.spark, self.path):
            if known is None:
                raise FileNotFoundError(self.path)
            return known
        return (self.spark.read if known is None else self.spark.read.schema(known.schema)).parquet(self.path)

    def read(self, schema: T.StructType | str | None = None) -> DataFrame:
        """All rows; a table that is absent or was never filled is empty where a schema is given."""
        return self._stored(schema).drop(BUCKET)

    def write(self, df: DataFrame, sort: Sequence[str] = ()) -> None:
        """The whole table anew. ``sort`` orders rows inside each file, so that min/max statistics prune later reads."""
        self._put(self._placed(df), "static", sort)

    def _put(self, placed: DataFrame, how: str, sort: Sequence[str]) -> None:
        out = placed.repartition(self.buckets, BUCKET).sortWithinPartitions(BUCKET, *sort)
        out.write.mode("overwrite").option("partitionOverwriteMode", how).partitionBy(BUCKET).parquet(self.path)

    def merge(self, batch: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], schema: T.StructType | str | None = None, sort: Sequence[str] = ()) -> None:
        """Puts ``combine(rows of the touched buckets, batch)`` in the place of those buckets; ``combine`` keeps every row's key."""
        touched = [r[0] for r in self._placed(batch).select(BUCKET).distinct().collect()]  # at most ``buckets`` numbers
        if touched:
            old = self._stored(schema).filter(F.col(BUCKET).isin(touched)).drop(BUCKET)
            new = stable(self._placed(combine(old, batch)))
            self._put(new, "dynamic", sort)
            for bucket in {*touched} - {r[0] for r in new.select(BUCKET).distinct().collect()}:  # a bucket without rows isn't written
                path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{BUCKET}={bucket}")
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
            drop_stable(new)


def last_batch(spark: SparkSession, path: str) -> int:
    """The last micro-batch that ``mark_batch`` noted; -1 before the first."""
    return spark.read.schema("batch long").json(path).agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0] if exists(spark, path) else -1


def mark_batch(spark: SparkSession, path: str, batch: int) -> None:
    spark.createDataFrame([(batch,)], "batch long").coalesce(1).write.mode("append").json(path)
