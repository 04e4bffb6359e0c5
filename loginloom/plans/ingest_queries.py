"""Registered queries of sources, scalar functions and ingest, each with the SQL that it is compared with.

Raw lines are written by SQL expressions from the driver's events, so that the parsers' work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import features, ingest
from ..sources import logs
from .detection_queries import rounded
from .fixtures import DENSE_SQL, SPARSE_SQL, auth_dense, auth_sparse

QUERIES, ORACLE_SQL = {}, {}


def registered(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def _lines(rows: DataFrame, value) -> DataFrame:
    return rows.select(value.alias("value"), F.lit("events").alias("file"), "event_id")


@registered(
    "a06_normalize_windows",
    f"""{SPARSE_SQL} SELECT t, 'u' || usr || '@CORP' AS "user", '10.0.0.' || src AS source_host, CASE WHEN logon_id = 3 THEN 'SRV' || dst ELSE 'H' || dst END AS destination_host, CASE logon_id WHEN 3 THEN 'Kerberos' ELSE 'NTLM' END AS auth_type, CASE logon_id WHEN 3 THEN 'TGS' ELSE 'LogOn' END AS orientation, CASE WHEN logon_id = 3 THEN 1 ELSE success END AS success FROM e WHERE usr % 9 <> 0""",
)
def a06(spark, sf_dir):
    rows = auth_sparse(spark, sf_dir)
    text = F.format_string(
        '{"EventID": %d, "TimeCreated": "%s", "EventData": {"TargetUserName": "%s", "TargetDomainName": "corp.example", "IpAddress": "10.0.0.%d", "ServiceName": "srv%d$", "AuthenticationPackageName": "NTLM", "LogonType": "3", "Status": "0x0"}, "Computer": "h%d.corp.example"}',
        F.when(F.col("logon_id") == 3, 4769).when(F.col("success") == 1, 4624).otherwise(4625),
        F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.when(F.col("usr") % 9 == 0, "SYSTEM").otherwise(F.concat(F.lit("U"), F.col("usr"))),
        F.col("src"),
        F.col("dst"),
        F.col("dst"),
    )
    good, _ = logs.normalize_windows(_lines(rows, text))
    return good.select("t", "user", "source_host", "destination_host", "auth_type", "orientation", "success")


@registered("a09_normalize_sshd", f"""{SPARSE_SQL} SELECT t, 'u' || usr AS "user", '10.1.0.' || src AS source_host, 'H' || dst AS destination_host, CASE WHEN logon_id = 1 THEN 'Key' ELSE 'Password' END AS auth_type, success FROM e WHERE usr % 11 <> 0""")
def a09(spark, sf_dir):
    rows = auth_sparse(spark, sf_dir)
    text = F.when(F.col("usr") % 11 == 0, "Jan  1 00:00:00 h1 sshd[1]: Connection closed").otherwise(
        F.format_string("%s h%d sshd[%d]: %s %s for U%d from 10.1.0.%d port 22", F.date_format(F.timestamp_seconds("t"), "MMM d HH:mm:ss"), F.col("dst"), F.col("event_id"), F.when(F.col("success") == 1, "Accepted").otherwise("Failed"), F.when(F.col("logon_id") == 1, "publickey").otherwise("password"), F.col("usr"), F.col("src"))
    )
    good, _ = logs.normalize_sshd(_lines(rows, text), assume_year=2024)
    return good.select("t", "user", "source_host", "destination_host", "auth_type", "success")


@registered("a10_normalize_zeek", f"""{SPARSE_SQL} SELECT t, 'u' || usr || '@CORP' AS "user", '10.2.0.' || src AS source_host, 'FS' || dst AS destination_host, CASE WHEN logon_id = 0 THEN 'TGT' ELSE 'TGS' END AS orientation, success FROM e""")
def a10(spark, sf_dir):
    text = F.format_string('{"ts": %d.25, "id.orig_h": "10.2.0.%d", "id.resp_h": "10.9.9.9", "client": "U%d/CORP.EXAMPLE", "service": "cifs/fs%d.corp@CORP", "request_type": "%s", "success": %s}', "t", "src", "usr", "dst", F.when(F.col("logon_id") == 0, "AS").otherwise("TGS"), F.when(F.col("success") == 1, "true").otherwise("false"))
    good, _ = logs.normalize_zeek(_lines(auth_sparse(spark, sf_dir), text))
    return good.select("t", "user", "source_host", "destination_host", "orientation", "success")


@registered("a11_normalize_entra", f"""{SPARSE_SQL} SELECT t, 'u' || usr || '@CORP' AS "user", '10.3.0.' || src AS source_host, 'APP' || dst AS destination_host, success FROM e""")
def a11(spark, sf_dir):
    text = F.format_string('{"createdDateTime": "%s", "userPrincipalName": "U%d@corp.example", "ipAddress": "10.3.0.%d", "resourceDisplayName": "app%d", "status": {"errorCode": %d}}', F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), "usr", "src", "dst", F.when(F.col("success") == 1, 0).otherwise(50126))
    good, _ = logs.normalize_entra(_lines(auth_sparse(spark, sf_dir), text))
    return good.select("t", "user", "source_host", "destination_host", "success")


@registered("a12_normalize_okta", f"""{SPARSE_SQL} SELECT t, 'u' || usr || '@CORP' AS "user", '10.4.0.' || src AS source_host, CASE WHEN dst % 2 = 0 THEN 'APP' || dst ELSE 'OKTA' END AS destination_host, success FROM e WHERE logon_id <> 2""")
def a12(spark, sf_dir):
    text = F.format_string('{"eventType": "%s", "published": "%s", "actor": {"alternateId": "U%d@corp.example"}, "client": {"ipAddress": "10.4.0.%d"}, "target": [{"type": "%s", "displayName": "app%d"}], "outcome": {"result": "%s"}}', F.when(F.col("logon_id") == 2, "policy.rule.update").otherwise("user.session.start"), F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), "usr", "src", F.when(F.col("dst") % 2 == 0, "AppInstance").otherwise("User"), "dst", F.when(F.col("success") == 1, "SUCCESS").otherwise("FAILURE"))
    good, _ = logs.normalize_okta(_lines(auth_sparse(spark, sf_dir), text))
    return good.select("t", "user", "source_host", "destination_host", "success")


@registered("a13_normalize_tabular", f"""{SPARSE_SQL} SELECT t, 'u' || usr AS "user", 'S' || src AS source_host, 'D' || dst AS destination_host, success FROM e""")
def a13(spark, sf_dir):
    rows = auth_sparse(spark, sf_dir).select(F.col("t").alias("when"), F.concat(F.lit("U"), "usr").alias("who"), F.concat(F.lit("s"), "src", F.lit(".corp")).alias("from_host"), F.concat(F.lit("d"), "dst", F.lit("$")).alias("to_host"), F.when(F.col("success") == 1, "OK").otherwise("DENIED").alias("result"))
    good, _ = logs.normalize_tabular(rows, {"timestamp": "when", "user": "who", "source_host": "from_host", "destination_host": "to_host", "success": "result:OK"})
    return good.select("t", "user", "source_host", "destination_host", "success")


@registered("a14_profile_log_format", f"{SPARSE_SQL} SELECT 'f' || (event_id % 5) AS file, CASE event_id % 5 WHEN 0 THEN 'sshd' WHEN 1 THEN 'zeek' WHEN 2 THEN 'entra' WHEN 3 THEN 'windows' ELSE 'unknown' END AS format, CASE WHEN event_id % 5 = 4 THEN 0.0 ELSE 1.0 END::DOUBLE AS confidence FROM e GROUP BY ALL")
def a14(spark, sf_dir):
    kind = F.col("event_id") % 5
    text = F.when(kind == 0, F.format_string("Jan 1 00:00:00 h sshd[%d]: x", "event_id")).when(kind == 1, F.format_string('{"id.orig_h": "%d"}', "event_id")).when(kind == 2, F.format_string('{"userPrincipalName": "%d"}', "event_id")).when(kind == 3, F.format_string('{"EventID": %d}', "event_id")).otherwise(F.format_string("%d,x", "event_id"))
    rows = auth_sparse(spark, sf_dir).select(text.alias("value"), F.concat(F.lit("f"), kind).alias("file"))
    return logs.profile_log_format(rows)


@registered("a20_check_stream_contract", f"{DENSE_SQL}, z AS (SELECT max(event_id) - min(event_id) + 1 - count(DISTINCT event_id) AS gaps, count(*) - count(DISTINCT event_id) AS repeated FROM e), b AS (SELECT CAST(coalesce(sum((n.t < e.t)::INTEGER), 0) AS BIGINT) AS backwards FROM e JOIN e n ON n.event_id = e.event_id + 1) SELECT * FROM z, b")
def a20(spark, sf_dir):
    return ingest.stream_violations(auth_dense(spark, sf_dir))


@registered("a22_export_cef", f"{DENSE_SQL} SELECT event_id, 'CEF:0|loginloom|detector|1|login|suspicious login|' || (logon_id * 3) || '|rt=' || (t * 1000) || ' suser=user' || usr || ' shost=host' || src || ' dhost=host' || dst AS line FROM e")
def a22(spark, sf_dir):
    return logs.to_cef(auth_dense(spark, sf_dir).withColumn("risk", F.col("logon_id") * 0.3))


@registered("a23_export_ndjson", f"""{DENSE_SQL} SELECT event_id, '{{"dst":' || dst || ',"event_id":' || event_id || ',"src":' || src || ',"t":' || t || ',"usr":' || usr || '}}' AS line FROM e""")
def a23(spark, sf_dir):
    return logs.to_ndjson(auth_dense(spark, sf_dir).select("event_id", "t", "usr", "src", "dst"))


# ---- scalar functions -----------------------------------------------------------------------------------------------


@registered("b01_parse_event_time", f"{SPARSE_SQL} SELECT event_id, CASE WHEN event_id % 6 = 5 THEN NULL WHEN event_id % 6 = 3 THEN t - 7200 ELSE t END AS parsed FROM e")
def b01(spark, sf_dir):
    kind, at = F.col("event_id") % 6, F.timestamp_seconds("t")
    text = F.when(kind == 0, F.col("t").cast("string")).when(kind == 1, (F.col("t") * 1000 + 7).cast("string")).when(kind == 2, F.date_format(at, "yyyy-MM-dd HH:mm:ss")).when(kind == 3, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+02:00'")).when(kind == 4, F.date_format(at, "MMM d HH:mm:ss")).otherwise("yesterday")
    return auth_sparse(spark, sf_dir).select("event_id", S.parse_event_time(text, 2024).alias("parsed"))


@registered("b02_canonical_host", f"{SPARSE_SQL} SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'H' || dst WHEN 1 THEN '10.0.0.' || dst WHEN 2 THEN '' WHEN 3 THEN 'PC' || dst ELSE '10.1.1.' || dst END AS host FROM e")
def b02(spark, sf_dir):
    kind, d = F.col("event_id") % 5, F.col("dst").cast("string")
    text = F.when(kind == 0, F.concat(F.lit("h"), d, F.lit(".corp.example"))).when(kind == 1, F.concat(F.lit("10.0.0."), d)).when(kind == 2, "127.0.0.1").when(kind == 3, F.concat(F.lit("pc"), d, F.lit("$@REALM"))).otherwise(F.concat(F.lit("::ffff:10.1.1."), d))
    return auth_sparse(spark, sf_dir).select("event_id", S.canonical_host(text).alias("host"))


@registered("b03_canonical_user", f"{SPARSE_SQL} SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'u' || usr || '@CORP' WHEN 1 THEN 'u' || usr || '@LAB' WHEN 2 THEN 'u' || usr || '@DOM' ELSE 'u' || usr END AS name, CASE WHEN usr % 10 = 0 THEN 1 ELSE 0 END AS machine FROM e")
def b03(spark, sf_dir):
    kind, u = F.col("event_id") % 4, F.col("usr").cast("string")
    text = F.when(kind == 0, F.concat(F.lit("U"), u)).when(kind == 1, F.concat(F.lit("U"), u, F.lit("@lab.example"))).when(kind == 2, F.concat(F.lit("dom\\U"), u)).otherwise(F.concat(F.lit("u"), u))
    domain = F.when(kind == 0, "corp.example").otherwise("")
    account = F.when(F.col("usr") % 10 == 0, F.concat(F.lit("pc"), u, F.lit("$@X"))).otherwise(u)
    return auth_sparse(spark, sf_dir).select("event_id", S.canonical_user(text, domain).alias("name"), S.machine_account(account).alias("machine"))


@registered("b04_noise_and_logon_codes", f"{SPARSE_SQL} SELECT event_id, CAST(event_id % 3 = 0 AS INTEGER) AS noise, CASE logon_id WHEN 2 THEN 'Interactive' WHEN 3 THEN 'Network' ELSE 'Network' END AS logon_name, success AS ok FROM e")
def b04(spark, sf_dir):
    user = F.when(F.col("event_id") % 3 == 0, "Anonymous Logon@NT").otherwise("alice@X")
    word = F.when(F.col("success") == 1, " Success ").otherwise("Fail")
    return auth_sparse(spark, sf_dir).select("event_id", S.is_noise_account(user).cast("int").alias("noise"), S.logon_code_name(F.col("logon_id")).alias("logon_name"), S.parse_success(word).alias("ok"))


@registered("b05_service_host", f"{SPARSE_SQL} SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'FS' || dst ELSE '' END AS host FROM e")
def b05(spark, sf_dir):
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("cifs/fs"), F.col("dst"), F.lit(".corp@REALM"))).otherwise(F.concat(F.lit("alice"), F.col("dst"), F.lit("@REALM")))
    return auth_sparse(spark, sf_dir).select("event_id", S.service_host(text).alias("host"))


#: Raw spellings and, hand-made from the rule, the word that each stands for.
AUTH_SPELLINGS = {"ms kerberos package": "Kerberos", "MSV1_0": "NTLM", " msv ": "NTLM", "MICROSOFT_AUTHENTICATION_PACKAGE_V1_0": "NTLM", "NtLmSsp": "NTLM", "NTLM V2": "NTLM", "Negotiate": "Negotiate", "NegoExtender": "Other", "Wave": "Other", "": "Other", "KERBEROS": "Kerberos"}
LOGON_SPELLINGS = {"Network": "network", "Network_Cleartext": "network", "3": "network", "8": "network", "Cached Interactive": "interactive", "UNLOCK": "interactive", "2": "interactive", "Remote Interactive": "remote_interactive", "10": "remote_interactive", "Service": "service_batch", "batch": "service_batch", "NewCredentials": "other", "9": "other", "": "other"}
ORIENTATION_SPELLINGS = {"LogOn": "logon", " TGS ": "tgs", "tgt": "tgt", "AuthMap": "authmap", "LogOff": "other", "ScreenLock": "other"}


def spelled(words: dict[str, str], seed: int):
    """A spelling for each event, dealt by its id."""
    return F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(F.col("event_id") * seed, F.lit(len(words))) + 1).cast("int"))


def spelled_sql(words: dict[str, str], seed: int) -> str:
    return f"[{', '.join(repr(w) for w in words.values())}][(event_id * {seed}) % {len(words)} + 1]"


@registered("b08_canonical_words", f"{SPARSE_SQL} SELECT event_id, {spelled_sql(AUTH_SPELLINGS, 1)} AS auth, {spelled_sql(LOGON_SPELLINGS, 3)} AS logon, {spelled_sql(ORIENTATION_SPELLINGS, 5)} AS orientation FROM e")
def b08(spark, sf_dir):
    auth, logon, orientation = S.canonical_auth(spelled(AUTH_SPELLINGS, 1)), S.canonical_logon(spelled(LOGON_SPELLINGS, 3)), S.canonical_orientation(spelled(ORIENTATION_SPELLINGS, 5))
    return auth_sparse(spark, sf_dir).select("event_id", auth.alias("auth"), logon.alias("logon"), orientation.alias("orientation"))


@registered("b13_sigmoid_saturate_decay", f"{SPARSE_SQL} SELECT event_id, round(1 / (1 + exp(-(logon_id - 1.5::DOUBLE))), 6) AS sigmoid, round(1 - exp(-(logon_id / 4.0::DOUBLE)), 6) + 0.0 AS saturate, round(pow(0.5, (usr % 97) / 24.0::DOUBLE), 6) AS decay, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (logon_id - 1) / 2.0::DOUBLE)), 6) AS ramp FROM e")
def b13(spark, sf_dir):
    rows = auth_sparse(spark, sf_dir).withColumns({"sigmoid": S.sigmoid(F.col("logon_id") - 1.5), "saturate": S.saturate(F.col("logon_id") / 4.0), "decay": S.decay(F.col("usr") % 97, 24.0), "ramp": S.ramp(F.col("logon_id"), 1, 3)})
    return rounded(rows, "event_id", "sigmoid", "saturate", "decay", "ramp")


@registered("b14_oov_bucket", f"{SPARSE_SQL} SELECT event_id, CAST(1000 + ('0x' || substr(sha256('user' || chr(0) || 'u' || usr), 1, 16))::UBIGINT % 4096 AS BIGINT) AS bucket FROM e")
def b14(spark, sf_dir):
    return auth_sparse(spark, sf_dir).select("event_id", S.oov_bucket("user", F.concat(F.lit("u"), "usr"), 1_000, 4_096).alias("bucket"))


@registered("b15_severity_bands", f"{SPARSE_SQL}, r AS (SELECT event_id, (event_id % 100) / 100.0::DOUBLE AS risk FROM e) SELECT event_id, CASE WHEN risk >= 0.9 THEN 'critical' WHEN risk >= 0.75 THEN 'high' WHEN risk >= 0.5 THEN 'medium' ELSE 'low' END AS intelligence, CASE WHEN risk >= 0.85 THEN 'critical' WHEN risk >= 0.7 THEN 'high' WHEN risk >= 0.5 THEN 'medium' ELSE 'low' END AS console, CASE WHEN event_id % 13 = 0 OR event_id % 4 = 0 AND risk >= 0.9 THEN 'critical' WHEN event_id % 4 = 0 THEN 'high' WHEN risk >= 0.5 THEN 'medium' ELSE 'low' END AS incident FROM r")
def b15(spark, sf_dir):
    risk = (F.col("event_id") % 100) / 100.0
    return auth_sparse(spark, sf_dir).select("event_id", S.severity(risk, "intelligence").alias("intelligence"), S.severity(risk, "console").alias("console"), S.incident_severity(risk, F.col("event_id") % 13 == 0, (F.col("event_id") % 4 == 0).cast("int")).alias("incident"))


# ---- ingest ---------------------------------------------------------------------------------------------------------


@registered("c01_profile_raw", "\nUNION ALL ".join(f"(SELECT '{c}' AS \"column\", count(*) AS rows, CAST(count(*) FILTER ({c} IS NULL) AS BIGINT) AS missing, count(DISTINCT {c}) AS distinct_values FROM events)" for c in ("user_id", "event_type", "props")))
def c01(spark, sf_dir):
    return ingest.profile_raw(spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", "props"), ["user_id", "event_type", "props"])


@registered("c02_reject_with_reason", f"{SPARSE_SQL}, r AS (SELECT CASE WHEN event_id % 50 = 0 THEN 'timestamp' WHEN event_id % 70 = 0 THEN 'success' WHEN usr % 40 = 0 THEN 'user' ELSE 'valid' END AS reason FROM e) SELECT reason, count(*) AS n FROM r GROUP BY reason")
def c02(spark, sf_dir):
    e = auth_sparse(spark, sf_dir)
    raw = e.select("event_id", F.when(F.col("event_id") % 50 == 0, "bad").otherwise(F.col("t").cast("string")).alias("t_text"), F.when(F.col("event_id") % 70 == 0, "?").when(F.col("success") == 1, "Success").otherwise("Fail").alias("success_text"), F.when(F.col("usr") % 40 == 0, "").otherwise(F.col("usr").cast("string")).alias("usr_text"))
    good, bad = ingest.reject_with_reason(raw)
    return good.select(F.lit("valid").alias("reason")).union(bad.select("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@registered("c05_drop_self_loops", f"{DENSE_SQL}, q AS (SELECT *, src % 30 AS s2, dst % 30 AS d2 FROM e) SELECT count(*) AS n_rows, CAST(count(*) FILTER (s2 = d2) AS BIGINT) AS self_loops, CAST(count(*) FILTER (s2 = d2 AND label = 1) AS BIGINT) AS labelled_self_loops, CAST(sum(label) AS BIGINT) AS labelled, CAST(sum(1 - success) AS BIGINT) AS failures, count(DISTINCT usr) AS users, min(t) AS first_t, max(t) AS last_t FROM q")
def c05(spark, sf_dir):
    e = auth_dense(spark, sf_dir).withColumns({"src": F.col("src") % 30, "dst": F.col("dst") % 30})
    return ingest.report(e)


@registered("c06_stride_sample", f"{DENSE_SQL}, q AS (SELECT *, row_number() OVER (ORDER BY t, event_id) - 1 AS p FROM e) SELECT event_id, t, label FROM q WHERE label = 1 OR p % 10 = 0")
def c06(spark, sf_dir):
    return ingest.stride_sample(auth_dense(spark, sf_dir), 10).select("event_id", "t", "label")


@registered("c08_label_events", f"{DENSE_SQL}, l AS (SELECT DISTINCT CASE WHEN event_id % 4 = 0 THEN t + 1 ELSE t END AS t, usr, src, dst FROM e WHERE label = 1) SELECT 'event' AS part, e.t, e.usr, e.src, e.dst FROM e JOIN l ON l.t = e.t AND l.usr = e.usr AND l.src = e.src AND l.dst = e.dst UNION ALL SELECT 'unmatched', t, usr, src, dst FROM l WHERE NOT EXISTS (SELECT 1 FROM e WHERE l.t = e.t AND l.usr = e.usr AND l.src = e.src AND l.dst = e.dst)")
def c08(spark, sf_dir):
    e = auth_dense(spark, sf_dir)
    labels = e.filter("label = 1").withColumn("t", F.when(F.col("event_id") % 4 == 0, F.col("t") + 1).otherwise(F.col("t")))
    hits, lost = ingest.label_events(e, labels)
    return hits.filter("hit = 1").select(F.lit("event").alias("part"), "t", "usr", "src", "dst").union(lost.select(F.lit("unmatched"), "t", "usr", "src", "dst"))


@registered("c10_drop_exact_duplicates", f"{DENSE_SQL}, q AS (SELECT event_id, t // 60 AS t, usr % 5 AS usr, src % 5 AS src, dst % 5 AS dst, success FROM e) SELECT min(event_id) AS event_id, t, usr, src, dst, success FROM q GROUP BY t, usr, src, dst, success")
def c10(spark, sf_dir):
    e = auth_dense(spark, sf_dir).withColumns({"t": F.floor(F.col("t") / 60), "usr": F.col("usr") % 5, "src": F.col("src") % 5, "dst": F.col("dst") % 5})
    return ingest.drop_exact_duplicates(e).select("event_id", "t", "usr", "src", "dst", "success")


@registered("c11_assign_event_ids", f"{DENSE_SQL} SELECT event_id, row_number() OVER (ORDER BY t, event_id) - 1 AS dense_id FROM e")
def c11(spark, sf_dir):
    return ingest.with_event_id(auth_dense(spark, sf_dir), ["t", "event_id"]).select("event_id", "dense_id")


_ROLES = "v AS (SELECT t, event_id, 0 AS role, 'h' || src AS value FROM e UNION ALL SELECT t, event_id, 1, 'h' || dst FROM e), d0 AS (SELECT value, min((t, event_id, role)) AS first FROM v GROUP BY value), d AS (SELECT value, row_number() OVER (ORDER BY first, value) AS id FROM d0)"


def _hosts(e: DataFrame) -> DataFrame:
    both = F.explode(F.array(F.struct(F.lit(0).alias("role"), F.concat(F.lit("h"), "src").alias("value")), F.struct(F.lit(1).alias("role"), F.concat(F.lit("h"), "dst").alias("value")))).alias("r")
    return e.select("t", "event_id", both).select("t", "event_id", "r.role", "r.value")


@registered("c12_build_dictionary", f"{DENSE_SQL}, {_ROLES} SELECT value, id FROM d")
def c12(spark, sf_dir):
    return ingest.build_dictionary(_hosts(auth_dense(spark, sf_dir)))


@registered("c13_encode_entities", f"{DENSE_SQL}, {_ROLES} SELECT e.event_id, coalesce(d.id, 0) AS host_id FROM e LEFT JOIN d ON d.value = 'h' || e.src AND d.id <= 50")
def c13(spark, sf_dir):
    e = auth_dense(spark, sf_dir)
    names = ingest.build_dictionary(_hosts(e)).filter("id <= 50")
    return ingest.encode(e.withColumn("host", F.concat(F.lit("h"), "src")), names, "host").select("event_id", "host_id")


@registered("c15_ingest_report", f"{SPARSE_SQL} SELECT count(*) AS n_rows, CAST(count(*) FILTER (src = dst) AS BIGINT) AS self_loops, CAST(count(*) FILTER (src = dst AND label = 1) AS BIGINT) AS labelled_self_loops, CAST(sum(label) AS BIGINT) AS labelled, CAST(sum(1 - success) AS BIGINT) AS failures, count(DISTINCT usr) AS users, min(t) AS first_t, max(t) AS last_t FROM e")
def c15(spark, sf_dir):
    return ingest.report(auth_sparse(spark, sf_dir))


@registered("c17_union_streams", f"{DENSE_SQL} SELECT event_id, t, CASE WHEN event_id % 2 = 0 THEN usr END AS usr FROM e")
def c17(spark, sf_dir):
    e = auth_dense(spark, sf_dir)
    return ingest.union_streams(e.filter("event_id % 2 = 0").select("event_id", "t", "usr"), e.filter("event_id % 2 <> 0").select("event_id", "t"))


@registered("c07_bound_time", f"{SPARSE_SQL} SELECT event_id, t FROM e WHERE t <= 1704900000")
def c07(spark, sf_dir):
    return auth_sparse(spark, sf_dir).filter("t <= 1704900000").select("event_id", "t")
