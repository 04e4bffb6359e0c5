"""Registered queries over files: what a landing folder holds is written from the driver's events into the shared folder, then read
back through the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..shared import fresh_path
from ..sources import columns, logs
from .fixtures import DENSE_SQL, SPARSE_SQL, auth_dense, auth_sparse

QUERIES, ORACLE_SQL = {}, {}


def registered(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def _name(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def landed(spark, lines, name: str, **options) -> str:
    """Lines (one string column) as text files in the shared folder."""
    path = fresh_path(spark, name)
    lines.write.options(**options).text(path)
    return path


@registered(
    "a01_scan_auth_csv",
    f"""{SPARSE_SQL} SELECT event_id % 13 = 5 AS broken, CASE WHEN event_id % 13 <> 5 THEN t END AS time, 'U' || usr AS src_user, CASE WHEN event_id % 7 <> 0 THEN 'U' || (usr + 1) END AS dst_user, 'C' || src AS src_host, 'C' || dst AS dst_host,
        CASE WHEN k % 4 <> 1 THEN auth_name END AS auth_type, orient_name AS orientation, CASE success WHEN 1 THEN 'Success' ELSE 'Fail' END AS success FROM (SELECT *, (dst - 20) AS k FROM e)""",
)
def a01(spark, sf_dir):
    """Headerless gzip files; a row in thirteen has a time that is no number."""
    k = F.col("dst") - 20
    time = F.when(F.col("event_id") % 13 == 5, "x").otherwise(F.col("t").cast("string"))
    cells = [time, _name("U", "usr"), F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("U"), F.col("usr") + 1)).otherwise("?"), _name("C", "src"), _name("C", "dst"), F.when(k % 4 != 1, F.col("auth_name")).otherwise("?"), F.lit("Network"), F.col("orient_name"), F.when(F.col("success") == 1, "Success").otherwise("Fail")]
    rows = logs.read_auth(spark, landed(spark, auth_sparse(spark, sf_dir).select(F.concat_ws(",", *cells)), "auth", compression="gzip"))
    return rows.select(F.col("_corrupt_record").isNotNull().alias("broken"), "time", "src_user", "dst_user", "src_host", "dst_host", "auth_type", "orientation", "success")


@registered("a02_scan_redteam_csv", f"""{SPARSE_SQL} SELECT t AS time, 'U' || usr AS "user", 'C' || src AS src_host, 'C' || dst AS dst_host, CAST(2 * count(*) AS BIGINT) AS "count" FROM e WHERE label = 1 GROUP BY ALL""")
def a02(spark, sf_dir):
    """Every label stands in the file twice."""
    rows = auth_sparse(spark, sf_dir).filter("label = 1").select(F.concat_ws(",", "t", _name("U", "usr"), _name("C", "src"), _name("C", "dst")))
    return logs.read_redteam(spark, landed(spark, rows.union(rows), "redteam"))


@registered("a03_scan_generic_labels", f"""{SPARSE_SQL} SELECT DISTINCT t, 'U' || usr AS "user", 'C' || src AS src_host, 'C' || dst AS dst_host FROM e WHERE label = 1""")
def a03(spark, sf_dir):
    """Epoch and ISO times in one folder, each file with a header, labels repeated."""
    rows = auth_sparse(spark, sf_dir).filter("label = 1")
    iso = F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    time = F.when(F.col("event_id") % 2 == 0, iso).otherwise(F.col("t").cast("string"))
    table = rows.select(time.alias("time"), _name("U", "usr").alias("user"), _name(" C", "src").alias("src_host"), _name("C", "dst").alias("dst_host"))
    path = fresh_path(spark, "labels")
    table.union(table).write.option("header", "true").csv(path)
    return logs.read_generic_labels(spark, path)


@registered("a04_scan_proc_starts", f"""{SPARSE_SQL} SELECT t // 86400 AS day, t AS time, CASE WHEN usr % 3 = 0 THEN -1 ELSE usr END AS user_id, CASE WHEN dst % 5 = 0 THEN -1 ELSE dst END AS host_id, 'P' || (event_id % 23) AS proc FROM e WHERE success = 1""")
def a04(spark, sf_dir):
    e = auth_sparse(spark, sf_dir)
    cells = ["t", _name("U", "usr"), _name("C", "dst"), F.concat(F.lit("P"), F.col("event_id") % 23), F.when(F.col("success") == 1, "Start").otherwise("End")]
    known = lambda prefix, c, n: e.filter(F.col(c) % n != 0).select(_name(prefix, c).alias("name"), F.col(c).alias("id")).distinct()
    rows = logs.read_proc_starts(spark, landed(spark, e.select(F.concat_ws(",", *cells)), "proc"), known("U", "usr", 3), known("C", "dst", 5))
    return rows.select("day", "time", "user_id", "host_id", "proc")


@registered("a05_scan_flows_dns", f"""{SPARSE_SQL} SELECT 'flow' AS kind, t AS time, 'C' || src AS src_host, 'C' || dst AS dst_host, CASE WHEN event_id % 3 <> 0 THEN 'N' || (event_id % 100) END AS src_port, CAST(k AS BIGINT) AS bytes FROM (SELECT *, dst - 20 AS k FROM e) UNION ALL SELECT 'dns', t, 'C' || src, 'C' || dst, NULL, NULL FROM e WHERE success = 1""")
def a05(spark, sf_dir):
    e = auth_sparse(spark, sf_dir)
    port = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("N"), F.col("event_id") % 100)).otherwise("?")
    flows = logs.read_flows(spark, landed(spark, e.select(F.concat_ws(",", "t", F.lit("9"), _name("C", "src"), port, _name("C", "dst"), F.lit("443"), F.lit("6"), F.lit("10"), F.col("dst") - 20)), "flows"))
    dns = logs.read_dns(spark, landed(spark, e.filter("success = 1").select(F.concat_ws(",", "t", _name("C", "src"), _name("C", "dst"))), "dns"))
    none = F.lit(None)
    return flows.select(F.lit("flow").alias("kind"), "time", "src_host", "dst_host", "src_port", "bytes").union(dns.select(F.lit("dns"), "time", "src_host", "dst_host", none.cast("string"), none.cast("long")))


@registered(
    "a07_windows_rules",
    f"""{SPARSE_SQL}, c AS (SELECT *, [4624, 4625, 4768, 4769, 4776, 4688][event_id % 6 + 1] AS code, ['0x0', '0x18', '0xc000006a'][event_id % 3 + 1] AS status FROM e)
    SELECT event_id, CASE WHEN code = 4688 THEN 'event' WHEN usr % 9 = 0 THEN 'noise account' END AS reason, CASE WHEN code = 4688 OR usr % 9 = 0 THEN NULL ELSE CASE code WHEN 4768 THEN 'Kerberos' WHEN 4769 THEN 'Kerberos' WHEN 4776 THEN 'NTLM' ELSE 'Negotiate' END END AS auth_type,
        CASE WHEN code = 4688 OR usr % 9 = 0 THEN NULL ELSE CASE code WHEN 4768 THEN 'TGT' WHEN 4769 THEN 'TGS' ELSE 'LogOn' END END AS orientation,
        CASE WHEN code = 4688 OR usr % 9 = 0 THEN NULL ELSE CASE WHEN code = 4769 THEN 'SRV' || dst ELSE 'DC' || src END END AS destination_host,
        CASE WHEN code = 4688 OR usr % 9 = 0 THEN NULL ELSE CASE WHEN code = 4624 THEN 1 WHEN code = 4625 THEN 0 ELSE CAST(status = '0x0' AS INTEGER) END END AS success FROM c""",
)
def a07(spark, sf_dir):
    """All event codes and status codes, below winlog.event_data or at the top; what isn't taken has a reason."""
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.col("event_id"), F.lit(n)) + 1).cast("int"))
    user = F.when(F.col("usr") % 9 == 0, "ANONYMOUS LOGON").otherwise(_name("u", "usr"))
    fields = F.struct(user.alias("TargetUserName"), F.concat(F.lit("srv"), "dst", F.lit("$")).alias("ServiceName"), pick(("0x0", "0x18", "0xc000006a"), 3).alias("Status"), F.lit("Negotiate").alias("AuthenticationPackageName"), F.lit("10.0.0.9").alias("IpAddress"))
    time, computer, code = F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.concat(F.lit("dc"), "src", F.lit(".corp")), pick((4624, 4625, 4768, 4769, 4776, 4688), 6)
    nested = F.to_json(F.struct(F.struct(fields.alias("event_data")).alias("winlog"), F.struct(code.alias("code")).alias("event"), time.alias("@timestamp"), computer.alias("Hostname")))
    top = F.to_json(F.struct(code.alias("EventID"), time.alias("EventTime"), computer.alias("Computer"), *[fields.getField(n).alias(n) for n in ("TargetUserName", "ServiceName", "Status", "AuthenticationPackageName", "IpAddress")]))
    text = F.when(F.col("src") % 2 == 0, nested).otherwise(top)
    rows = auth_sparse(spark, sf_dir).select(F.concat(F.lit('{"n":'), F.col("event_id").cast("string"), F.lit(","), F.substr(text, F.lit(2))).alias("value"), F.lit("events").alias("file"))
    good, bad = logs.normalize_windows(rows, keep=("value",))
    number = F.get_json_object("value", "$.n").cast("long").alias("event_id")
    return good.select(number, F.lit(None).cast("string").alias("reason"), "auth_type", "orientation", "destination_host", "success").unionByName(bad.select(number, "reason"), allowMissingColumns=True)


_XML = "<Event xmlns='http://schemas.microsoft.com/win/2004/08/events/event'><System><Provider Name='Security'/><EventID Qualifiers='0'>%d</EventID><TimeCreated SystemTime='%s'/><Computer>h%d.corp.example</Computer></System><EventData><Data Name='TargetUserName'>%s</Data><Data Name='TargetDomainName'>corp.example</Data><Data Name='IpAddress'>10.0.0.%d</Data><Data Name='ServiceName'>srv%d$</Data><Data Name='AuthenticationPackageName'>NTLM</Data><Data Name='LogonType'>3</Data><Data>unnamed</Data><Data Name='Status'>0x0</Data></EventData></Event>"


@registered(
    "a08_normalize_windows_xml",
    f"""{SPARSE_SQL} SELECT t, 'u' || usr || '@CORP' AS "user", '10.0.0.' || src AS source_host, CASE WHEN logon_id = 3 THEN 'SRV' || dst ELSE 'H' || dst END AS destination_host, CASE logon_id WHEN 3 THEN 'Kerberos' ELSE 'NTLM' END AS auth_type, CASE logon_id WHEN 3 THEN 'TGS' ELSE 'LogOn' END AS orientation, CASE WHEN logon_id = 3 THEN 1 ELSE success END AS success FROM e WHERE usr % 9 <> 0 AND event_id % 17 <> 3""",
)
def a08(spark, sf_dir):
    """The events of a06 as XML; a document in seventeen is cut short."""
    user = F.when(F.col("usr") % 9 == 0, "SYSTEM").otherwise(_name("U", "usr"))
    code = F.when(F.col("logon_id") == 3, 4769).when(F.col("success") == 1, 4624).otherwise(4625)
    text = F.format_string(_XML, code, F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd'T'HH:mm:ss'.1234567Z'"), "dst", user, "src", "dst")
    text = F.when(F.col("event_id") % 17 == 3, F.substring(text, 1, 150)).otherwise(text)
    good, _ = logs.normalize_windows_xml(auth_sparse(spark, sf_dir).select(text.alias("value"), F.lit("events").alias("file")))
    return good.select("t", "user", "source_host", "destination_host", "auth_type", "orientation", "success")


@registered("a10_zeek_tsv", f"""{SPARSE_SQL} SELECT t, 'u' || usr || '@CORP' AS "user", '10.2.0.' || src AS source_host, CASE WHEN usr % 2 = 0 THEN 'FS' || dst ELSE 'NB' || dst END AS destination_host, CASE WHEN usr % 2 = 0 THEN 'Kerberos' ELSE 'NTLM' END AS auth_type, success FROM e""")
def a10(spark, sf_dir):
    """Kerberos and NTLM logs with a `#fields` line of their own each, columns in another order."""
    e, tab = auth_sparse(spark, sf_dir), "\t"
    flag, address = F.when(F.col("success") == 1, "T").otherwise("F"), F.concat(F.lit("10.2.0."), "src")
    kerberos = e.filter("usr % 2 = 0").select(F.concat_ws(tab, F.concat("t", F.lit(".5")), address, F.concat(F.lit("U"), "usr", F.lit("/CORP.EXAMPLE")), F.concat(F.lit("cifs/fs"), "dst", F.lit(".corp@CORP")), F.lit("TGS"), flag).alias("value"), F.lit("kerberos.log").alias("file"))
    ntlm = e.filter("usr % 2 = 1").select(F.concat_ws(tab, flag, F.concat(F.lit("nb"), "dst"), F.lit("CORP"), F.concat(F.lit("U"), "usr"), F.lit("-"), address, "t").alias("value"), F.lit("ntlm.log").alias("file"))
    heads = spark.createDataFrame([("#fields\tts\tid.orig_h\tclient\tservice\trequest_type\tsuccess", "kerberos.log"), ("#separator \\x09", "ntlm.log"), ("#fields\tsuccess\tserver_nb_computer_name\tdomainname\tusername\tid.resp_h\tid.orig_h\tts", "ntlm.log")], "value string, file string")
    good, _ = logs.normalize_zeek(logs.zeek_tsv_as_json(kerberos.union(ntlm).union(heads)))
    return good.select("t", "user", "source_host", "destination_host", "auth_type", "success")


#: Headers of four exports, in the order time, account, source, destination, outcome.
EXPORTS = (("Event Time", "User Principal", "Client Workstation", "Target Server", "Auth Result"), ("@timestamp", "account_name", "src_machine", "dest_machine", "status"), ("when", "who", "fromhost", "tohost", "verdict"), ("ts", "user", "source", "destination", "outcome"))
_FIELDS = ("timestamp", "user", "source_host", "destination_host", "success")


def _exports(spark, sf_dir) -> str:
    """The events as CSV, dealt to four kinds of export with columns in an order of their own; the folder that holds them."""
    folder = fresh_path(spark, "exports")
    e = auth_sparse(spark, sf_dir)
    for k, names in enumerate(EXPORTS):
        own = e.filter(F.col("event_id") % 4 == k)
        made = [F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), _name("u", "usr"), _name("ws", "src"), _name("fs", "dst"), F.when(F.col("success") == 1, "Allow" if k != 2 else "PASSED").otherwise("Deny")]
        table = [c.alias(n) for c, n in zip(made, names)]
        own.select(*table[k:], *table[:k]).write.option("header", "true").csv(f"{folder}/kind={k}")
    return folder


def _kind():
    return F.regexp_extract("file", "kind=([0-9])", 1).cast("int").alias("kind")


@registered("a15_infer_column_map", f"{SPARSE_SQL}, k AS (SELECT DISTINCT CAST(event_id % 4 AS INTEGER) AS kind FROM e) SELECT kind, field, [{', '.join(str(list(names)) for names in EXPORTS)}][kind + 1][place] AS header FROM k, (VALUES {', '.join(f'({i + 1}, {f!r})' for i, f in enumerate(_FIELDS))}) AS f(place, field)")
def a15(spark, sf_dir):
    """The columns of every export file, found by their names alone; the files of one kind must agree."""
    headers = columns.csv_headers(spark, f"{_exports(spark, sf_dir)}/*")
    return columns.infer_column_map(headers.select("file", "header")).select(_kind(), "field", "header").distinct()


@registered("a16_check_mapped_values", f"{SPARSE_SQL} SELECT CAST(event_id % 4 AS INTEGER) AS kind, 'success' AS warning FROM e WHERE event_id % 4 = 2 GROUP BY ALL")
def a16(spark, sf_dir):
    """The export whose outcomes no reader knows is warned of."""
    folder = f"{_exports(spark, sf_dir)}/*"
    headers = columns.csv_headers(spark, folder)
    mapped = columns.infer_column_map(headers.select("file", "header"))
    return columns.check_values(mapped, columns.csv_cells(spark, folder, headers)).select(_kind(), "warning").filter("warning <> 'one outcome'").distinct()


@registered("a15_read_landing_folder", f"""{SPARSE_SQL} SELECT t, 'u' || usr AS "user", 'WS' || src AS source_host, 'FS' || dst AS destination_host, CASE WHEN event_id % 4 = 2 THEN 0 ELSE success END AS success FROM e""")
def a15_read(spark, sf_dir):
    """All exports read through the maps that were inferred for them."""
    events, _ = columns.read_landing(spark, f"{_exports(spark, sf_dir)}/*")
    return events.select("t", "user", "source_host", "destination_host", "success")


@registered("a17_write_normalized", f"{DENSE_SQL} SELECT event_id, t, usr, src, dst, CAST(t // 86400 AS INTEGER) AS auth_day FROM e")
def a17(spark, sf_dir):
    path = fresh_path(spark, "normalized")
    logs.write_by_day(auth_dense(spark, sf_dir).select("event_id", "t", "usr", "src", "dst"), path)
    return spark.read.parquet(path)


@registered("a19_read_features", f"{SPARSE_SQL} SELECT event_id, t, CASE WHEN t // 86400 % 2 = 0 THEN (event_id % 10) / 10.0::DOUBLE ELSE -1.0 END AS burst, CAST(usr % 5 AS BIGINT) AS degree FROM e")
def a19(spark, sf_dir):
    """Features written by two versions of a job, of which the older one lacked a column: that has its default."""
    path = fresh_path(spark, "features")
    e = auth_sparse(spark, sf_dir).select("event_id", "t", (F.col("usr") % 5).alias("degree"))
    even = F.floor(F.col("t") / 86_400) % 2 == 0
    logs.write_features(e.filter(even).withColumn("burst", (F.col("event_id") % 10) / 10.0), f"{path}/age=1", column="feature_day")
    logs.write_features(e.filter(~even), f"{path}/age=0", column="feature_day")
    return logs.read_features(spark, path, {"burst": -1.0}).select("event_id", "t", "burst", "degree")


@registered("a24_dataset_provenance")
def a24(spark, sf_dir):
    """Digests of the normalized files, by name; the tests hash the same bytes."""
    path = fresh_path(spark, "normalized")
    auth_dense(spark, sf_dir).select("event_id", "t", "usr", "src", "dst").write.csv(path)
    return logs.provenance(spark, path)
