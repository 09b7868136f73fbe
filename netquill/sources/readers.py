"""Batch and streaming readers of logs, files, intelligence, allowlists and training data."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from netquill.functions.net import ip_long, ipv6_hex
from netquill.sources.schemas import log_schema

MAX_FILE_BYTES = 50 * 1024 * 1024


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])


def parse_lines(lines: DataFrame, log_type: str, keep_bad: bool = False) -> DataFrame:
    """Records of JSON lines (column ``value``); blank and malformed lines are skipped, or kept alone with ``keep_bad``."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    record = F.from_json("value", _with_corrupt(log_schema(log_type)), options)
    parsed = lines.where(F.trim("value") != "").select("value", record.alias("r"))
    if keep_bad:
        return parsed.where("r is null or r._corrupt_record is not null").select("value")
    return parsed.where("r is not null and r._corrupt_record is null").select(*[F.col(f"r.`{c}`").alias(c) for c in log_schema(log_type).names])


def read_logs(spark: SparkSession, directory: str, log_type: str) -> DataFrame:
    """The records of ``<directory>/<log_type>.log`` (file, folder or glob of JSON lines); absent: none."""
    try:
        return parse_lines(spark.read.text(f"{directory}/{log_type}.log*"), log_type)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], log_schema(log_type))


def stream_logs(spark: SparkSession, log_type: str, source: dict) -> DataFrame:
    """A stream of records from a topic (``{"kafka.bootstrap.servers": ..}``) or from files arriving in a folder (``{"path": ..}``).

    Files are taken whole once they appear; writers should move complete files into the folder.
    """
    if "path" in source:
        reader = spark.readStream.format("text")
        if "maxFilesPerTrigger" in source:
            reader = reader.option("maxFilesPerTrigger", source["maxFilesPerTrigger"])
        return parse_lines(reader.load(source["path"]), log_type)
    options = {"subscribe": log_type, **source}
    return parse_lines(spark.readStream.format("kafka").options(**options).load().select(F.col("value").cast("string").alias("value")), log_type)


def read_eve(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path), "eve")


def read_files(spark: SparkSession, directory: str, max_bytes: int = MAX_FILE_BYTES, streaming: bool = False, pattern: str = "*") -> DataFrame:
    """``path, length, modificationTime, content`` of files up to a size."""
    reader = spark.readStream.schema("path string, modificationTime timestamp, length bigint, content binary") if streaming else spark.read
    files = reader.format("binaryFile").option("pathGlobFilter", pattern).load(directory)
    return files.where(F.col("length") <= max_bytes).select("path", "length", "modificationTime", "content")


def read_ja4_intel(spark: SparkSession, path: str) -> DataFrame:
    """Two tiers of fingerprints, ``{"malicious": {ja4: {..}}, "dual_use": {..}}``, as rows ``tier, ja4, application, fingerprint_type, notes``."""
    entry = "map<string, struct<application: string, fingerprint_type: string, notes: string>>"
    raw = spark.read.schema(f"malicious {entry}, dual_use {entry}").json(path, multiLine=True)
    tiers = [raw.select(F.lit(t).alias("tier"), F.explode(t).alias("ja4", "e")) for t in ("malicious", "dual_use")]
    return tiers[0].unionByName(tiers[1]).select("tier", "ja4", "e.application", "e.fingerprint_type", "e.notes")


RULE = (
    "id string, reason string, threat_class array<string>, severity array<string>, detection_mode array<string>, src array<string>, dst array<string>,"
    " src_port array<int>, dst_port array<int>, evidence map<string, string>, expires string, critical_ok boolean, enabled boolean"
)


def _bad_network(nets: Column) -> Column:
    address, bits = (lambda n: F.split(n, "/")[0]), (lambda n: F.try_element_at(F.split(n, "/"), F.lit(2)))
    known = lambda n: (ip_long(address(n)).isNotNull() & (F.coalesce(bits(n), F.lit("32")).try_cast("int").between(0, 32))) | (
        ipv6_hex(address(n)).isNotNull() & F.coalesce(bits(n), F.lit("128")).try_cast("int").between(0, 128)
    )
    return F.coalesce(F.exists(nets, lambda n: ~F.coalesce(known(n), F.lit(False))), F.lit(False))


def check_rules(rules: DataFrame, today: str) -> tuple[DataFrame, DataFrame]:
    """(usable rules, problems): disabled rules are dropped silently, invalid and expired ones become ``id, problem`` rows."""
    on = rules.where(F.coalesce("enabled", F.lit(True))).withColumn("id", F.substring(F.coalesce("id", "reason", F.lit("?")), 1, 60))
    nothing = F.coalesce("src", "dst").isNull() & F.coalesce("src_port", "dst_port").isNull() & F.col("evidence").isNull()
    day = F.to_date(F.expr("try_to_timestamp(expires, 'yyyy-MM-dd')"))
    problem = (
        F.when(F.trim(F.coalesce("reason", F.lit(""))) == "", "missing reason")
        .when(nothing, "needs at least one of src/dst/dst_port/src_port/evidence")
        .when(F.col("expires").isNotNull() & day.isNull(), "bad expires date")
        .when(day < F.lit(today).cast("date"), F.concat(F.lit("expired "), F.col("expires")))
        .when(_bad_network(F.col("src")) | _bad_network(F.col("dst")), "bad address")
    )
    judged = on.withColumn("problem", problem)
    return judged.where("problem is null").drop("problem"), judged.where("problem is not null").select("id", "problem")


def load_allowlist(spark: SparkSession, path: str, today: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rules and problems of ``{"rules": [..]}``; ``rule_order`` is a rule's place in the file. Single values count as lists."""
    fields = T.StructType.fromDDL(RULE)
    raw = spark.read.schema("rules array<string>").json(path, multiLine=True).select(F.posexplode("rules").alias("rule_order", "rule"))

    def column(f: T.StructField) -> Column:
        if isinstance(f.dataType, T.ArrayType):
            text = F.get_json_object("rule", f"$.{f.name}")
            listed = F.when(text.startswith("["), F.from_json(text, "array<string>")).otherwise(F.when(text.isNotNull(), F.array(text)))
            return listed.cast(f.dataType).alias(f.name)
        if isinstance(f.dataType, T.MapType):
            return F.from_json(F.get_json_object("rule", f"$.{f.name}"), f.dataType).alias(f.name)
        return F.get_json_object("rule", f"$.{f.name}").cast(f.dataType).alias(f.name)

    return check_rules(raw.select("rule_order", *map(column, fields)), today or date.today().isoformat())


def read_benign_domains(spark: SparkSession, path: str) -> DataFrame:
    """One domain a line, comments after ``#`` removed."""
    name = F.lower(F.trim(F.split("value", "#")[0]))
    return spark.read.text(path).select(name.alias("domain")).where(F.col("domain").contains(".")).distinct()


TRAINING = {
    "flow": "duration_s double, orig_bytes double, resp_bytes double, proto string, label string, source_file string",
    "dns": "domain string, label string",
    "modbus": "modbus_func string, register_address double, register_sweep_count double, label string",
    "tls": "ja4 string, sni string, label string",
}


def read_training(spark: SparkSession, path: str, family: str, benign: str = "benign") -> DataFrame:
    """Labelled CSV rows with ``label`` as 0 (benign) or 1; a file of a single class is an error."""
    rows = spark.read.csv(path, header=True, schema=TRAINING[family], enforceSchema=False)
    rows = rows.withColumn("label", F.when(F.lower("label").isin(benign, "0"), 0).otherwise(1))
    if rows.select("label").distinct().count() < 2:
        raise ValueError(f"{path} has a single class")
    return rows


def packets_page(packets: DataFrame, start: int, limit: int, terms: str = "") -> tuple[DataFrame, DataFrame]:
    """A page of packets from id ``start`` on that match the terms, and one row with the ``next`` id (null at the end)."""
    from netquill.operators.mapping import packet_line
    from netquill.operators.predicates import search_terms

    rows = packets.where(F.col("id") >= start)
    if terms:
        rows = search_terms(rows.withColumn("line", packet_line()), "line", terms).drop("line")
    page = rows.orderBy("id").limit(limit)
    return page, page.agg(F.when(F.count("*") == limit, F.max("id") + 1).alias("next"))


def dedup_files(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """One row for each content: ``sha256``, the first path, how many copies."""
    return files.groupBy(F.sha2(F.col(content), 256).alias("sha256")).agg(F.min(path).alias("path"), F.count("*").alias("copies"))
