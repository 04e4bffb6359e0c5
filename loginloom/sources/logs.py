"""Log formats to one table of source events. Each normaliser takes lines (value, file, pos) and returns (events, rejects)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S

FIELDS = ("t", "user", "source_host", "destination_host", "destination_user", "auth_type", "logon_type", "orientation", "success", "source")

AUTH_SCHEMA = T.StructType([T.StructField("time", T.LongType())] + [T.StructField(c, T.StringType()) for c in ("src_user", "dst_user", "src_host", "dst_host", "auth_type", "logon_type", "orientation", "success")] + [T.StructField("_corrupt_record", T.StringType())])
REDTEAM_SCHEMA = "time long, user string, src_host string, dst_host string"
PROC_SCHEMA = "time long, user string, host string, proc string, action string"
FLOW_SCHEMA = "time long, duration long, src_host string, src_port string, dst_host string, dst_port string, protocol string, packets long, bytes long"
DNS_SCHEMA = "time long, src_host string, dst_host string"


def read_auth(spark: SparkSession, path: str) -> DataFrame:
    """Nine headerless columns, `?` for missing; bad rows keep their text in _corrupt_record. A gzip file is one task's
    work, so rows are dealt anew after the read."""
    return spark.read.schema(AUTH_SCHEMA).csv(path, nullValue="?", mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record").repartition(F.col("time"))


def read_redteam(spark: SparkSession, path: str) -> DataFrame:
    """Label rows with the number of their repetitions; a bad row is an error, and so is a file without rows."""
    rows = spark.read.schema(REDTEAM_SCHEMA).csv(path, mode="FAILFAST").groupBy("time", "user", "src_host", "dst_host").count()
    if rows.isEmpty():
        raise ValueError(f"no labels in {path}")
    return rows


def read_generic_labels(spark: SparkSession, path: str) -> DataFrame:
    """t, user, src_host, dst_host of label files with or without a header, with epoch or ISO times; each label once."""
    rows = spark.read.schema("time string, user string, src_host string, dst_host string").csv(path)
    named = rows.select(S.parse_event_time(F.col("time")).alias("t"), F.trim("user").alias("user"), F.trim("src_host").alias("src_host"), F.trim("dst_host").alias("dst_host"), "time")
    headers = F.lower(F.trim("time")).isin("time", "timestamp", "t")
    small = F.when(named["time"].rlike("^ *[0-9]{1,8} *$"), F.trim("time").cast("long"))  # seconds since a corpus began
    return named.filter(~headers).select(F.coalesce("t", small).alias("t"), "user", "src_host", "dst_host").dropDuplicates()


def read_proc_starts(spark: SparkSession, path: str, users: DataFrame | None = None, hosts: DataFrame | None = None) -> DataFrame:
    """Process starts with day, the hash of the process name and, given dictionaries (name, id), ids; -1 is unknown."""
    rows = spark.read.schema(PROC_SCHEMA).csv(path).filter("action = 'Start'").withColumns({"proc_hash": F.xxhash64("proc"), "day": F.floor(F.col("time") / 86_400)})
    for name, known in (("user", users), ("host", hosts)):
        if known is not None:
            ids = known.select(F.col("name").alias(name), F.col("id").alias(f"{name}_id"))
            rows = rows.join(ids, name, "left").withColumn(f"{name}_id", F.coalesce(f"{name}_id", F.lit(-1)))
    return rows


def read_flows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FLOW_SCHEMA).csv(path, nullValue="?")


def read_dns(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DNS_SCHEMA).csv(path, nullValue="?")


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.input_file_name().alias("file"))


def _once(rows: DataFrame, made: dict) -> DataFrame:
    """rows with further columns, each computed once a row.

    A filter on computed columns moves below their projection and repeats their expressions at every use, and those of the lines that
    they read; it doesn't move below a generator.
    """
    kept = [c for c in rows.columns if c not in made]
    return rows.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))


class _Json:
    """Paths of the JSON lines in `value` as columns; `read` gives the rows with these columns, each path looked up once a row."""

    def __init__(self):
        self.columns = {}

    def __call__(self, path: str):
        return F.col(self.columns.setdefault(path, f"_json{len(self.columns)}"))

    def read(self, rows: DataFrame) -> DataFrame:
        return _once(rows, {n: F.get_json_object("value", p) for p, n in self.columns.items()})


def _split(rows: DataFrame, reason, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    marked = rows.withColumn("reason", reason)
    return marked.filter("reason IS NULL").select(*FIELDS, *keep), marked.filter("reason IS NOT NULL").select("value", "reason")


def normalize_windows(rows: DataFrame, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Security events as JSON lines: fields at the top, under EventData, or under winlog.event_data. keep: columns that go along."""
    path = _Json()
    get = lambda *names: F.coalesce(*[path(f"$.{p}{n}") for n in names for p in ("", "EventData.", "winlog.event_data.")])
    code = F.coalesce(get("EventID", "event_id"), path("$.event.code")).try_cast("int")
    fields = {
        "code": code,
        "t": S.parse_event_time(F.coalesce(get("TimeCreated", "EventTime"), path("$['@timestamp']"))),
        "user": S.canonical_user(get("TargetUserName"), get("TargetDomainName")),
        "source_host": S.canonical_host(F.coalesce(get("IpAddress"), get("WorkstationName"), get("Workstation"))),
        "destination_host": F.when(code == 4769, S.canonical_host(get("ServiceName"))).otherwise(S.canonical_host(get("Computer", "Hostname"))),
        "destination_user": S.canonical_user(get("TargetUserName"), get("TargetDomainName")),
        "auth_type": F.when(code.isin(4768, 4769), "Kerberos").when(code == 4776, "NTLM").otherwise(S.canonical_auth(get("AuthenticationPackageName"))),
        "logon_type": S.logon_code_name(get("LogonType").try_cast("int")),
        "orientation": F.when(code == 4768, "TGT").when(code == 4769, "TGS").otherwise("LogOn"),
        "success": F.when(code == 4624, 1).when(code == 4625, 0).otherwise((F.coalesce(get("Status"), F.lit("0x0")) == "0x0").cast("int")),
        "source": F.lit("windows"),
    }
    reason = F.when(path("$").isNull(), "json").when(F.col("code").isNull() | ~F.col("code").isin(4624, 4625, 4768, 4769, 4776), "event").when(F.col("t").isNull(), "timestamp").when(S.is_noise_account(get("TargetUserName")), "noise account").when(F.col("destination_host") == "", "destination")
    return _split(_once(path.read(rows), fields), reason, keep)


WINDOWS_XML = "System struct<EventID struct<_VALUE string>, TimeCreated struct<_SystemTime string>, Computer string>, EventData struct<Data array<struct<_Name string, _VALUE string>>>"


def normalize_windows_xml(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Security events as XML documents, one a row, as the event log exports them: rejects that aren't such XML say `xml`.

    Named data become a map, of repeated names the last value; the rules are those of normalize_windows.
    """
    data = F.col("doc.EventData.Data")
    names = F.array_distinct(F.filter(F.transform(data, lambda d: d["_Name"]), lambda n: n.isNotNull()))
    last = F.transform(names, lambda n: F.trim(F.coalesce(F.element_at(F.filter(data, lambda d: d["_Name"] == n), -1)["_VALUE"], F.lit(""))))
    parsed = _once(rows, {"doc": F.from_xml("value", WINDOWS_XML)})
    code = F.trim("doc.System.EventID._VALUE")
    is_event = F.coalesce(code.rlike("^[0-9]+$"), F.lit(False))
    record = F.struct(code.try_cast("int").alias("EventID"), F.col("doc.System.TimeCreated._SystemTime").alias("TimeCreated"), F.col("doc.System.Computer").alias("Computer"), F.map_from_arrays(names, last).alias("EventData"))
    good, bad = normalize_windows(parsed.filter(is_event).withColumn("value", F.to_json(record)).drop("doc"))
    return good, bad.union(parsed.filter(~is_event).select("value", F.lit("xml")))


def zeek_tsv_as_json(rows: DataFrame) -> DataFrame:
    """Tab-separated Zeek lines (value, file) as JSON lines, by the `#fields` line of their file; `-` and `(empty)` are missing.

    A file has one such line, so the table of them is small beside the rows and Spark may broadcast it. Lines of a file without one
    stay as they are, for the rejects.
    """
    fields = rows.filter(F.col("value").startswith("#fields\t")).groupBy("file").agg(F.min("value").alias("_line"))
    names = F.slice(F.split("_line", "\t"), 2, 10_000)
    cells = F.transform(F.split("value", "\t"), lambda x: F.when(~x.isin("-", "(empty)", ""), x))
    held = F.least(F.size(names), F.size(cells))
    pairs = F.filter(F.arrays_zip(F.slice(names, F.lit(1), held).alias("n"), F.slice(cells, F.lit(1), held).alias("c")), lambda p: p["c"].isNotNull())
    as_json = F.to_json(F.map_from_arrays(F.transform(pairs, lambda p: p["n"]), F.transform(pairs, lambda p: p["c"])))
    return rows.filter(~F.col("value").startswith("#")).join(fields, "file", "left").withColumn("value", F.coalesce(as_json, "value")).drop("_line")


def normalize_sshd(rows: DataFrame, assume_year: int) -> tuple[DataFrame, DataFrame]:
    """Accepted, failed and invalid-user lines with syslog or ISO stamps."""
    line = r"^(\S+ +\d+ [\d:]{8}|\d{4}-\S+) (\S+) sshd\[\d+\]: (Accepted|Failed) (\S+) for (?:invalid user )?(\S+) from (\S+) port"
    part = lambda i: F.col(f"_part{i}")
    fields = {
        "t": S.parse_event_time(part(1), assume_year),
        "user": F.lower(part(5)),
        "source_host": S.canonical_host(part(6)),
        "destination_host": S.canonical_host(part(2)),
        "destination_user": F.lower(part(5)),
        "auth_type": F.when(part(4) == "publickey", "Key").otherwise("Password"),
        "logon_type": F.lit("RemoteInteractive"),
        "orientation": F.lit("LogOn"),
        "success": (part(3) == "Accepted").cast("int"),
        "source": F.lit("sshd"),
    }
    parts = _once(rows, {f"_part{i}": F.regexp_extract("value", line, i) for i in (1, 2, 3, 4, 5, 6)})
    return _split(_once(parts, fields), F.when(part(5) == "", "no logon").when(F.col("t").isNull(), "timestamp"))


def normalize_zeek(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kerberos and NTLM records as JSON lines."""
    path = _Json()
    get = lambda n: path(f"$['{n}']")
    kerberos = get("client").isNotNull()
    fields = {
        "t": F.floor(get("ts").cast("double")).cast("long"),
        "user": F.when(kerberos, S.canonical_user(F.split_part(get("client"), F.lit("/"), F.lit(1)), F.split_part(get("client"), F.lit("/"), F.lit(2)))).otherwise(S.canonical_user(get("username"), get("domainname"))),
        "source_host": S.canonical_host(get("id.orig_h")),
        "destination_host": F.when(kerberos & (S.service_host(get("service")) != ""), S.service_host(get("service"))).otherwise(S.canonical_host(F.coalesce(get("server_nb_computer_name"), get("id.resp_h")))),
        "destination_user": F.lit(None).cast("string"),
        "auth_type": F.when(kerberos, "Kerberos").otherwise("NTLM"),
        "logon_type": F.lit("Network"),
        "orientation": F.when(get("request_type") == "AS", "TGT").when(get("request_type") == "TGS", "TGS").otherwise("LogOn"),
        "success": F.coalesce(get("success"), F.lit("true")).isin("true", "T").cast("int"),
        "source": F.lit("zeek"),
    }
    reason = F.when(F.col("t").isNull(), "timestamp").when(F.coalesce(get("client"), get("username")).isNull(), "user")
    return _split(_once(path.read(rows), fields), reason)


def normalize_entra(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sign-ins: one JSON object a line, or an envelope whose `value` holds many."""
    kept = [c for c in rows.columns if c != "value"]
    many = F.from_json(F.get_json_object("value", "$.value"), T.ArrayType(T.StringType()))
    rows = rows.select(*kept, F.explode(F.coalesce(many, F.array("value"))).alias("value"))
    path = _Json()
    get = lambda p: path(f"$.{p}")
    fields = {
        "t": S.parse_event_time(get("createdDateTime")),
        "user": S.canonical_user(get("userPrincipalName"), F.lit("")),
        "source_host": S.canonical_host(get("ipAddress")),
        "destination_host": F.upper(F.coalesce(get("resourceDisplayName"), get("appDisplayName"), F.lit(""))),
        "destination_user": F.lit(None).cast("string"),
        "auth_type": F.lit("Other"),
        "logon_type": F.lit("Network"),
        "orientation": F.lit("LogOn"),
        "success": (F.coalesce(get("status.errorCode"), F.lit("0")) == "0").cast("int"),
        "source": F.lit("entra"),
    }
    return _split(_once(path.read(rows), fields), F.when(F.col("t").isNull(), "timestamp").when(F.col("user") == "", "user"))


def normalize_okta(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Session and authentication events; the target is the first application, else a constant host."""
    path = _Json()
    get = lambda p: path(f"$.{p}")
    targets = F.from_json(get("target"), "array<struct<type:string,displayName:string>>")
    app = F.get(F.filter(targets, lambda x: x["type"] == "AppInstance"), F.lit(0))["displayName"]
    fields = {
        "t": S.parse_event_time(get("published")),
        "user": S.canonical_user(get("actor.alternateId"), F.lit("")),
        "source_host": S.canonical_host(get("client.ipAddress")),
        "destination_host": F.upper(F.coalesce(app, F.lit("OKTA"))),
        "destination_user": F.lit(None).cast("string"),
        "auth_type": F.lit("Other"),
        "logon_type": F.lit("Network"),
        "orientation": F.lit("LogOn"),
        "success": (F.coalesce(get("outcome.result"), F.lit("")) == "SUCCESS").cast("int"),
        "source": F.lit("okta"),
    }
    reason = F.when(~F.coalesce(get("eventType"), F.lit("")).rlike(r"^user\.(session|authentication)"), "event").when(F.col("t").isNull(), "timestamp")
    return _split(_once(path.read(rows), fields), reason)


def normalize_tabular(df: DataFrame, mapping: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Any table through field=column; success=column:value takes that value as success."""
    field = lambda f: F.col(mapping[f]).cast("string") if f in mapping else F.lit(None).cast("string")
    if ":" in mapping.get("success", ""):
        column, _, word = mapping["success"].partition(":")
        success = (F.col(column).cast("string") == word).cast("int")
    else:
        success = S.parse_success(field("success")) if "success" in mapping else F.lit(1)
    made = _once(df, {"value": F.to_json(F.struct(*df.columns)), "t": S.parse_event_time(field("timestamp")), "user": F.lower(field("user")), "source_host": S.canonical_host(field("source_host")), "destination_host": S.canonical_host(field("destination_host")), "destination_user": field("destination_user"), "auth_type": S.canonical_auth(field("auth_type")), "logon_type": F.coalesce(field("logon_type"), F.lit("Network")), "orientation": F.coalesce(field("orientation"), F.lit("LogOn")), "success": success, "source": F.lit("tabular")})
    return _split(made, F.when(F.col("t").isNull(), "timestamp").when(F.coalesce("user", F.lit("")) == "", "user"))


MARKS = {
    "windows": r'"(EventID|event_id|winlog)"',
    "sshd": r"sshd\[\d+\]:",
    "zeek": r'"id\.orig_h"',
    "entra": r'"userPrincipalName"',
    "okta": r'"actor"\s*:|"published"',
}


def profile_log_format(rows: DataFrame, sample: int = 200) -> DataFrame:
    """file, format, confidence: the format whose mark most of a file's lines show. At most `sample` lines of each file are
    looked at, chosen by hash, since this only names a format."""
    from pyspark.sql import Window

    w = Window.partitionBy("file").orderBy(F.xxhash64("value"))
    some = rows.filter("trim(value) <> ''").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= sample)
    shares = some.groupBy("file").agg(*[F.avg(F.col("value").rlike(m).cast("double")).alias(k) for k, m in MARKS.items()])
    best = F.array_max(F.array(*[F.struct(F.col(k).alias("share"), F.lit(k).alias("format")) for k in MARKS]))
    return shares.select("file", F.when(best["share"] >= 0.5, best["format"]).otherwise("unknown").alias("format"), F.round(best["share"], 6).alias("confidence"))


def to_cef(alerts: DataFrame) -> DataFrame:
    """One CEF line for each alert, with escapes, milliseconds of epoch."""
    esc = lambda c: F.regexp_replace(F.regexp_replace(c.cast("string"), r"\\", r"\\\\\\\\"), "=", r"\\\\=")
    level = F.round(F.col("risk") * 10).cast("int")
    return alerts.select("event_id", F.concat(F.lit("CEF:0|loginloom|detector|1|login|suspicious login|"), level, F.lit("|rt="), F.col("t") * 1000, F.lit(" suser=user"), esc(F.col("usr")), F.lit(" shost=host"), esc(F.col("src")), F.lit(" dhost=host"), esc(F.col("dst"))).alias("line"))


def to_ndjson(alerts: DataFrame) -> DataFrame:
    """One JSON line for each alert, keys sorted."""
    return alerts.select("event_id", F.to_json(F.struct(*sorted(alerts.columns))).alias("line"))


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def write_by_day(events: DataFrame, path: str, column: str = "auth_day", report: bool = False) -> None:
    """Parquet by day, all of it or none: written beside the target, then moved there in one step.

    An existing folder is never overwritten, and a write that fails leaves nothing. Days are dealt by size, so a large day
    has several writers. report: whether `_report`, which readers of the table pass over, holds a JSON line with the counts of each day.
    """
    spark = events.sparkSession
    files, target = _file_system(spark, path)
    if files.exists(target):
        raise FileExistsError(path)
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    _, at = _file_system(spark, staged)
    try:
        events.withColumn(column, F.floor(F.col("t") / 86_400).cast("int")).hint("rebalance", F.col(column)).write.partitionBy(column).option("compression", "zstd").parquet(staged)
        if report:
            days = spark.read.parquet(staged).groupBy(column).agg(F.count("*").alias("rows"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))
            days.coalesce(1).write.json(f"{staged}/_report")
        files.mkdirs(target.getParent())
        if files.exists(target) or not files.rename(at, target):
            raise FileExistsError(path)
    except BaseException:
        files.delete(at, True)
        raise


def write_features(features: DataFrame, path: str, column: str = "feature_day") -> None:
    """Features by day with a report of their counts, published at once."""
    write_by_day(features, path, column, report=True)


def read_features(spark: SparkSession, path: str, defaults: dict[str, float], required: tuple[str, ...] = ("event_id", "t")) -> DataFrame:
    """Feature files of several ages: columns that older ones lack get their default; a required column that none has is an error."""
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    lacking = [c for c in required if c not in rows.columns]
    if lacking:
        raise ValueError(f"no column {', '.join(lacking)} in {path}")
    for name, value in defaults.items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in rows.columns else F.lit(value))
    return rows


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """file, sha256, dataset_sha256 (of the sorted file:digest lines)."""
    files = spark.read.format("binaryFile").load(path).select(F.substring_index("path", "/", -1).alias("file"), F.sha2("content", 256).alias("sha256"))
    whole = files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "file", "sha256"))), "\n"), 256).alias("dataset_sha256"))
    return files.join(F.broadcast(whole))


def one_format(profile: DataFrame) -> str:
    """The format that all files of a profile have; several formats, or one that isn't known, are an error that names files."""
    found = profile.groupBy("format").agg(F.min("file").alias("file")).orderBy("format").collect()  # a row for each format
    if not found:
        raise ValueError("no lines to tell a format from")
    if len(found) > 1:
        raise ValueError("one format at a time: " + ", ".join(f"{r.format} in {r.file}" for r in found))
    if found[0].format == "unknown":
        raise ValueError(f"nothing in {found[0].file} tells its format")
    return found[0].format
