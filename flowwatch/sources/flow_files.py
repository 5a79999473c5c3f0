"""Readers of raw flow files and writers of predictions, splits and reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowwatch.functions.exprs import q

# The eight capture files of the public intrusion data set.
CAPTURE_FILES = (
    "Monday-WorkingHours.pcap_ISCX.csv",
    "Tuesday-WorkingHours.pcap_ISCX.csv",
    "Wednesday-workingHours.pcap_ISCX.csv",
    "Thursday-WorkingHours-Morning-WebAttacks.pcap_ISCX.csv",
    "Thursday-WorkingHours-Afternoon-Infilteration.pcap_ISCX.csv",
    "Friday-WorkingHours-Morning.pcap_ISCX.csv",
    "Friday-WorkingHours-Afternoon-DDos.pcap_ISCX.csv",
    "Friday-WorkingHours-Afternoon-PortScan.pcap_ISCX.csv",
)
# Text columns of those files; every other column is a number.
TEXT_COLUMNS = ("Flow ID", "Source IP", "Destination IP", "Timestamp", "Label")

# Columns of the public headerless files, in file order.
HEADERLESS_COLUMNS = (
    "duration", "protocol_type", "service", "flag", "src_bytes", "dst_bytes", "land", "wrong_fragment", "urgent",
    "hot", "num_failed_logins", "logged_in", "num_compromised", "root_shell", "su_attempted", "num_root",
    "num_file_creations", "num_shells", "num_access_files", "num_outbound_cmds", "is_host_login",
    "is_guest_login", "count", "srv_count", "serror_rate", "srv_serror_rate", "rerror_rate", "srv_rerror_rate",
    "same_srv_rate", "diff_srv_rate", "srv_diff_host_rate", "dst_host_count", "dst_host_srv_count",
    "dst_host_same_srv_rate", "dst_host_diff_srv_rate", "dst_host_same_src_port_rate",
    "dst_host_srv_diff_host_rate", "dst_host_serror_rate", "dst_host_srv_serror_rate", "dst_host_rerror_rate",
    "dst_host_srv_rerror_rate", "label", "difficulty",
)
HEADERLESS_TEXT = ("protocol_type", "service", "flag", "label")
HEADERLESS_FILES = ("KDDTrain+.txt", "KDDTest+.txt")


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def typed_schema(names: Sequence[str], text: Sequence[str]) -> T.StructType:
    return T.StructType([
        T.StructField(n, T.StringType() if n.strip() in text else T.DoubleType()) for n in names])


def header_names(line: str) -> list[str]:
    """Column names of a header line; a name that comes again gets ``.1``, ``.2``, ..., the first keeps its own."""
    seen: dict[str, int] = {}
    out = []
    for name in line.rstrip("\r\n").split(","):
        again = seen.get(name, 0)
        seen[name] = again + 1
        out.append(f"{name}.{again}" if again else name)
    return out


def read_flow_csvs(spark: SparkSession, folder: str, files: Sequence[str] | None = None,
                   schema: T.StructType | None = None) -> DataFrame:
    """Named Latin-1 CSV files as one frame with ``source_file``, the name that was asked for.

    Rows with nothing in any column go before ``source_file`` is added. Without
    a schema only the header lines are read, never the data twice: each file is read by its own header, and the
    files are joined by column name; a column that a file lacks is null in its rows.
    """
    out: DataFrame | None = None
    for f in files or CAPTURE_FILES:
        path = f"{folder.rstrip('/')}/{f}"
        if not path_exists(spark, path):
            raise FileNotFoundError(path)
        own = schema
        if own is None:
            first = spark.read.option("encoding", "ISO-8859-1").text(path).first()
            own = typed_schema(header_names(first[0] if first else ""), TEXT_COLUMNS)
        raw = (spark.read.option("header", True).option("encoding", "ISO-8859-1").option("nanValue", "NaN")
               .option("positiveInf", "Infinity").option("negativeInf", "-Infinity").option("enforceSchema", True)
               .schema(own).csv(path))
        one = raw.dropna("all", subset=[f"`{c}`" for c in raw.columns]).withColumn("source_file", F.lit(f))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None or out.columns[-1] == "source_file":
        return out
    return out.select(*[q(c) for c in out.columns if c != "source_file"], "source_file")


def read_headerless_flows(spark: SparkSession, folder: str, files: Sequence[str] = HEADERLESS_FILES,
                          names: Sequence[str] = HEADERLESS_COLUMNS, text: Sequence[str] = HEADERLESS_TEXT,
                          label: str = "label", out_label: str = "Label") -> DataFrame:
    """Headerless files with a fixed schema; ``normal`` becomes ``BENIGN``, other labels are trimmed."""
    schema = typed_schema(names, text)
    out: DataFrame | None = None
    for f in files:
        one = spark.read.schema(schema).csv(f"{folder.rstrip('/')}/{f}").withColumn(
            "source_file", F.lit(f.rsplit(".", 1)[0]))
        out = one if out is None else out.unionByName(one)
    trimmed = F.trim(q(label))
    unified = F.when(F.lower(trimmed) == "normal", "BENIGN").otherwise(trimmed)
    return out.select(*[unified.alias(out_label) if c == label else q(c) for c in out.columns])


def read_scoring_file(spark: SparkSession, path: str, fitted: Sequence[str]) -> DataFrame:
    """Flows to score from a Parquet folder or a CSV file with a header, as :func:`read_scoring_input` gives them."""
    if path.endswith(".csv"):
        first = spark.read.option("encoding", "ISO-8859-1").text(path).first()
        schema = typed_schema(header_names(first[0] if first else ""), TEXT_COLUMNS)
        return read_scoring_input(spark.read.option("header", True).option("encoding", "ISO-8859-1").schema(schema).csv(path), fitted)
    return read_scoring_input(spark.read.parquet(path), fitted)


def read_scoring_input(df: DataFrame, fitted: Sequence[str]) -> DataFrame:
    """Trimmed names, required-column check, and the fitted columns in fitted order."""
    named = df.toDF(*[c.strip() for c in df.columns])
    lacking = [c for c in fitted if c not in named.columns]
    if lacking:
        raise ValueError(f"input is missing required columns: {lacking}")
    return named.select(*[q(c) for c in fitted])


def write_predictions(df: DataFrame, path: str, pred: str = "pred", score: str | None = "score",
                      fmt: str = "parquet") -> dict[str, float]:
    """Writes input columns plus ``anomaly_score`` and ``is_attack``; returns the flagged share."""
    out = df.withColumn("is_attack", q(pred).cast("int"))
    drop = [pred]
    if score is not None:
        out = out.withColumn("anomaly_score", q(score))
        drop.append(score)
    out = out.drop(*drop)
    writer = out.write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)
    # Counted from one column of what was written, so nothing is scored twice.
    back = df.sparkSession.read.format(fmt)
    back = back.option("header", True).schema(out.schema) if fmt == "csv" else back
    row = back.load(path).agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("is_attack"), F.lit(0)).alias("flagged")).first()
    return {"rows": row["rows"], "flagged": row["flagged"],
            "rate": row["flagged"] / row["rows"] if row["rows"] else 0.0}


def write_model_ready(df: DataFrame, path: str, split: str = "split") -> None:
    """Processed rows, partitioned by split, with labels and row ids beside the features."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def read_model_ready(spark: SparkSession, path: str, split: str | None = None,
                     cols: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if split is not None:
        df = df.filter(F.col("split") == split)
    return df.select(*[q(c) for c in cols]) if cols else df


def write_report_tables(tables: Mapping[str, DataFrame], folder: str, fmt: str = "csv") -> list[str]:
    """One folder per result table."""
    paths = []
    for name, df in tables.items():
        path = f"{folder.rstrip('/')}/{name}"
        writer = df.write.mode("overwrite")
        (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)
        paths.append(path)
    return paths
