"""Column inference, formats and files: the cases that exports bring, and writes that fail."""

import hashlib
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from loginloom.functions import scalars
from loginloom.plans import landing_queries, registry
from loginloom.sources import columns, logs
from tests.test_registered import SF, TABLES, _plain


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(landing_queries.ORACLE_SQL))
def test_landing_queries_equal_sql(spark, con, name):
    want = con.execute(registry.oracle_sql()[name])
    names, rows = [c[0] for c in want.description], want.fetchall()
    got = registry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert rows and _plain(map(tuple, got.select(*names).collect())) == _plain(rows)


def fields_of(spark, headers):
    rows = spark.createDataFrame([("f", h) for h in headers], "file string, header string")
    return {r.field: r.header for r in columns.infer_column_map(rows).collect()}


def test_host_columns_settle_against_each_other(spark):
    for order in (["@timestamp", "account_name", "dest_machine", "src_machine", "status"], ["src_machine", "status", "dest_machine", "account_name", "@timestamp"]):
        got = fields_of(spark, order)
        assert got == {"timestamp": "@timestamp", "user": "account_name", "source_host": "src_machine", "destination_host": "dest_machine", "success": "status"}


def test_headers_nobody_has_seen(spark):
    got = fields_of(spark, ["Event Time", "User Principal", "Client Workstation", "Target Server", "Auth Result", "Protocol"])
    assert got == {"timestamp": "Event Time", "user": "User Principal", "source_host": "Client Workstation", "destination_host": "Target Server", "success": "Auth Result", "auth_type": "Protocol"}
    assert fields_of(spark, ["event_time", "account", "client", "server", "result", "protocol"])["destination_host"] == "server"
    assert fields_of(spark, ["", " ", "?!"]) == {}


def test_scores_of_headers(spark):
    cases = [("source_host", "SourceHost", 10), ("source_host", "originDevice", 6), ("source_host", "source_target_host", 2), ("destination_host", "computer", 10), ("destination_host", "asset", 3), ("source_host", "asset", 0), ("timestamp", "utc", 3), ("logon_type", "session_kind", 6), ("success", "weather", 0)]
    for field, header, want in cases:
        assert spark.range(1).select(columns.header_score(field, F.lit(header))).first()[0] == want, (field, header)


def test_required_columns_are_named(spark):
    rows = spark.createDataFrame([("a.csv", h) for h in ("when", "who", "result")] + [("b.csv", h) for h in ("ts", "user", "src", "dst")], "file string, header string")
    got = {r.file: r.missing for r in columns.missing_fields(rows, columns.infer_column_map(rows)).collect()}
    assert got == {"a.csv": ["destination_host", "source_host"]}


def landing(tmp_path, **files):
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text)
    return str(tmp_path)


def test_a_folder_is_read_through_its_own_maps(spark, tmp_path):
    folder = landing(
        tmp_path,
        siem='Event Time,User Principal,"Client, Workstation",Target Server,Auth Result,Protocol\n2026-03-02T09:14:03Z,alice@corp.example,WS05,FS01,ALLOW,Kerberos\n2026-03-02T09:15:00Z,bob@corp.example,WS07,DB01,DENY,MSV1_0\n',
        vpn="dest_machine,src_machine,@timestamp,account_name,status\nFS02,WS01,1772442843,carol,success\n",
    )
    events, _ = columns.read_landing(spark, folder)
    got = sorted((r.user, r.source_host, r.destination_host, r.success, r.auth_type) for r in events.collect())
    assert got == [("alice@corp.example", "WS05", "FS01", 1, "Kerberos"), ("bob@corp.example", "WS07", "DB01", 0, "NTLM"), ("carol", "WS01", "FS02", 1, "Other")]


def test_a_folder_with_an_unreadable_file_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="destination_host"):
        columns.read_landing(spark, landing(tmp_path, odd="when,who,result\n2026-03-02T09:14:03Z,alice,SUCCESS\n"))


def test_values_are_held_against_the_mapping(spark, tmp_path):
    folder = landing(
        tmp_path,
        unread="ts,user,src,dst,verdict\n2026-03-02T09:14:03Z,alice,WS05,FS01,PASSED\n2026-03-02T09:15:03Z,alice,WS05,DB01,BLOCKED\n",
        silent="ts,user,src,dst\n2026-03-02T09:14:03Z,alice,WS05,FS01\n2026-03-02T09:15:03Z,alice,FS01,DB01\n",
        loops="ts,user,src,dst,result\nMar  2 09:14:03,alice,WS05,WS05,ok\nMar  2 09:14:04,bob,DB01,DB01,ok\n",
        fine="ts,user,src,dst,result\n2026-03-02T09:14:03Z,alice,WS05,FS01,ok\n2026-03-02T09:14:03Z,alice,WS05,FS02,denied\n",
    )
    headers = columns.csv_headers(spark, folder)
    mapped = columns.infer_column_map(headers.select("file", "header"))
    rows = columns.check_values(mapped, columns.csv_cells(spark, folder, headers)).collect()
    got = {}
    for r in rows:
        got.setdefault(os.path.basename(r.file), set()).add(r.warning)
    assert got == {"unread.csv": {"success"}, "silent.csv": {"no outcome"}, "loops.csv": {"time", "loop", "one outcome"}}


def test_xml_cases(spark):
    doc = "<Event xmlns='urn:x'><System><EventID>{}</EventID><TimeCreated SystemTime='2026-03-02T09:14:03.1234567Z'/><Computer>dc1.corp</Computer></System><EventData>{}</EventData></Event>"
    data = lambda **kv: "".join(f"<Data Name='{k}'> {v} </Data>" for k, v in kv.items())
    rows = [
        doc.format(4776, data(TargetUserName="Alice", Workstation="WS1", Status="0xc000006a")),
        doc.format(4624, data(TargetUserName="bob", LogonType="10", AuthenticationPackageName="Negotiate", IpAddress="::1", WorkstationName="WS2") + "<Data Name='LogonType'>2</Data>"),
        doc.format("x", ""),
        "<Event><System>",
        "not xml",
        None,
        doc.format(4688, ""),
    ]
    good, bad = logs.normalize_windows_xml(spark.createDataFrame([(r, "f") for r in rows], "value string, file string"))
    got = sorted((r.user, r.source_host, r.destination_host, r.auth_type, r.logon_type, r.success, r.t) for r in good.collect())
    assert got == [("alice", "WS1", "DC1", "NTLM", "Network", 0, 1772442843), ("bob", "", "DC1", "Negotiate", "Interactive", 1, 1772442843)]
    assert sorted(r.reason for r in bad.collect()) == ["event", "xml", "xml", "xml", "xml"]


def test_words_of_categories(spark):
    row = spark.range(1).select(*[c.alias(n) for n, c in scalars.category_block(F.lit("MICROSOFT_AUTHENTICATION_PACKAGE_V1_0"), F.lit("Remote Interactive"), F.lit("ScreenLock"), F.lit(1)).items()]).first().asDict()
    assert len(row) == 15 and [k for k, v in row.items() if v] == ["auth_ntlm", "logon_remote_interactive", "orientation_other", "success"]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    rows = spark.range(20).select(F.col("id").alias("event_id"), (F.col("id") * 20_000).alias("t"))
    bad = rows.withColumn("x", F.when(F.col("event_id") == 19, F.raise_error("broken row").cast("long")).otherwise(F.col("event_id")))
    target = str(tmp_path / "features")
    with pytest.raises(Exception, match="broken row"):
        logs.write_features(bad, target)
    assert os.listdir(tmp_path) == []
    logs.write_features(rows.withColumn("x", F.col("event_id")), target)
    assert os.listdir(tmp_path) == ["features"]
    with pytest.raises(FileExistsError):
        logs.write_features(rows, target)
    assert spark.read.parquet(target).count() == 20 and spark.read.json(f"{target}/_report").agg(F.sum("rows")).first()[0] == 20


def test_features_of_several_ages(spark, tmp_path):
    rows = spark.range(4).select(F.col("id").alias("event_id"), F.col("id").alias("t"))
    logs.write_features(rows, str(tmp_path / "all" / "age=1"))
    logs.write_features(rows.withColumn("burst", F.lit(0.5)), str(tmp_path / "all" / "age=2"))
    got = logs.read_features(spark, str(tmp_path / "all"), {"burst": -1.0, "never": 7.0})
    assert sorted({(r.age, r.burst, r.never) for r in got.collect()}) == [(1, -1.0, 7.0), (2, 0.5, 7.0)]
    with pytest.raises(ValueError, match="usr"):
        logs.read_features(spark, str(tmp_path / "all"), {}, required=("event_id", "usr"))


def test_labels_without_rows_fail(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError, match="no labels"):
        logs.read_redteam(spark, str(tmp_path / "empty.csv"))
    (tmp_path / "wide.csv").write_text("x,U1,C1,C2\n")
    with pytest.raises(Exception):
        logs.read_redteam(spark, str(tmp_path / "wide.csv")).collect()


def test_provenance_of_the_bytes(spark, tmp_path):
    files = {"b.csv": b"two\n", "a.csv": b"one\n"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    sha = {n: hashlib.sha256(d).hexdigest() for n, d in files.items()}
    whole = hashlib.sha256("\n".join(sorted(f"{n}:{h}" for n, h in sha.items())).encode()).hexdigest()
    assert {(r.file, r.sha256, r.dataset_sha256) for r in logs.provenance(spark, str(tmp_path)).collect()} == {(n, h, whole) for n, h in sha.items()}
    rows = registry.queries()["a24_dataset_provenance"](spark, SF).collect()
    assert len({r.dataset_sha256 for r in rows}) == 1 and all(len(r.sha256) == 64 for r in rows)


def test_one_format_at_a_time(spark):
    sshd, okta = "Jan 1 00:00:00 h sshd[1]: x", '{"actor": {}, "published": "x"}'
    profile = lambda rows: logs.profile_log_format(spark.createDataFrame(rows, "value string, file string"))
    assert logs.one_format(profile([(sshd, "a"), (sshd, "b")])) == "sshd"
    with pytest.raises(ValueError, match="one format at a time"):
        logs.one_format(profile([(sshd, "a"), (okta, "b")]))
    with pytest.raises(ValueError, match="nothing in"):
        logs.one_format(profile([("the quick brown fox", "a")]))
    with pytest.raises(ValueError, match="no lines"):
        logs.one_format(profile([("", "a")]))


def test_lines_are_parsed_once(spark):
    """A line is made, parsed and looked up once a row, however many fields and rejects read it."""
    from loginloom.plans import registry

    for name, made, paths in (("a06_normalize_windows", 1, 53), ("a08_normalize_windows_xml", 2, 53), ("a10_normalize_zeek", 1, 11), ("a12_normalize_okta", 1, 6), ("a10_zeek_tsv", 0, 11)):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("format_string(") == made, name
        assert plan.count("get_json_object(value") <= paths and plan.count("XmlToStructs") + plan.count("from_xml(") + plan.count("xmltostructs(") <= 1, name
