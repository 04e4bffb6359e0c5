"""Which column of an unknown export holds what: scores of header names, best-first assignment, and a look at the values.

All work is on a landing folder at once: a table of (file, header), one file per export, and a sample of their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import logs

# Names that exports give to a field, words for the role that a column plays, words for the thing that it holds.
SYNONYMS = {
    "timestamp": "timestamp time eventtime datetime date ts when createddatetime created createdat logtime occurredat starttime eventtimestamp published authtime logontime receivedtime firstseen timegenerated timecreated",
    "user": "user username account accountname username1 principal upn userprincipalname subject actor identity login logonuser samaccountname srcuser sourceuser useridentity accountupn targetusername callername who userid userkey",
    "source_host": "sourcehost srchost source src client clienthost workstation workstationname sourcecomputer origin sourcemachine clientname sourceip srcip clientip ipaddress sourceaddress fromhost originhost devicename",
    "destination_host": "destinationhost dsthost destination dst dest desthost target targethost server servername resource destinationcomputer destinationip dstip destip targetserver tohost destinationaddress computer hostname host machine targetresource",
    "success": "success result outcome status authresult eventoutcome disposition resultcode logonresult authenticationresult succeeded issuccess ok allowed granted action verdict decision authstatus eventresult",
    "auth_type": "authtype authenticationtype protocol authprotocol authenticationpackage authenticationpackagename mechanism authmethod authenticationmethod package",
    "logon_type": "logontype logintype sessiontype type authtypecode connectiontype",
    "destination_user": "destinationuser targetuser dstuser impersonateduser runasuser",
    "domain": "domain domainname realm tenant tenantid ntdomain",
}
ROLES = {
    "source_host": "src source client origin from workstation caller initiator local requesting",
    "destination_host": "dst dest destination target to remote server resource requested accessed",
    "user": "user account principal actor subject identity login logon upn sam caller",
    "destination_user": "targetuser destuser dstuser impersonated runas",
    "timestamp": "time timestamp date created published occurred logged",
    "success": "success result outcome status disposition succeeded",
    "auth_type": "auth authentication protocol mechanism package",
    "logon_type": "logon login session connection",
    "domain": "domain realm tenant",
}
HOSTS = "host hostname machine computer device server workstation node endpoint ip ipaddress address system asset name"
USERS = "user username account accountname principal upn name id"
TIMES = "time timestamp date datetime epoch utc at"
TYPES = "type method protocol package mechanism kind"
THINGS = {"source_host": HOSTS, "destination_host": HOSTS, "user": USERS, "destination_user": USERS, "timestamp": TIMES, "success": "", "auth_type": TYPES, "logon_type": TYPES, "domain": ""}
#: Fields in the order in which equal scores are settled; without the first four a file can't be read.
ORDER = ("timestamp", "user", "source_host", "destination_host", "success", "auth_type", "logon_type", "destination_user", "domain")
REQUIRED = ORDER[:4]
#: Fields for which a bare thing has a usual meaning, and fields whose roles shut each other out.
BARE = ("destination_host", "timestamp", "user")
RIVAL = {"source_host": "destination_host", "destination_host": "source_host"}


def _words(text: str) -> Column:
    return F.array(*[F.lit(w) for w in text.split()]) if text else F.array().cast("array<string>")


def header_score(field: str, header: Column) -> Column:
    """How well a header fits a field: 10 for a known name, 6 or 5 for a role with its thing (of several words or one), 2 if the
    rival's role is in it too, 3 for a bare thing, else 0."""
    plain = F.regexp_replace(F.lower(F.trim(header)), "[^a-z0-9]", "")
    spaced = F.regexp_replace(F.trim(header), "(?<=[a-z0-9])(?=[A-Z])", " ")
    tokens = F.array_distinct(F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda x: x != ""))
    affix = F.lit(False)
    for w in ROLES[field].split():
        if len(w) >= 4:
            affix = affix | plain.startswith(w) | plain.endswith(w)
    role = F.arrays_overlap(tokens, _words(ROLES[field])) | affix
    thing = F.arrays_overlap(tokens, _words(THINGS[field])) if THINGS[field] else F.lit(True)
    both = F.when(F.size(tokens) > 1, 6.0).otherwise(5.0)
    if field in RIVAL:
        both = F.when(F.arrays_overlap(tokens, _words(ROLES[RIVAL[field]])), 2.0).otherwise(both)
    out = F.when(plain == "", 0.0).when(F.array_contains(_words(SYNONYMS[field]), plain), 10.0).when(role & thing, both)
    if field in BARE:
        out = out.when(~role & thing, 3.0)
    return F.coalesce(out.otherwise(0.0), F.lit(0.0))


def infer_column_map(headers: DataFrame) -> DataFrame:
    """file, field, header, score: each field's column, each column for one field, the best scores first.

    headers: file, header. Equal scores go by the order of fields, then to the header that sorts last. A file's candidates are
    folded in that order, so two host columns settle against each other and not by their place in the file.
    """
    scored = F.array(*[F.struct(header_score(f, F.col("header")).alias("score"), F.lit(-i).alias("rank"), F.lit(f).alias("field"), F.col("header").alias("header")) for i, f in enumerate(ORDER)])
    some = headers.filter(F.coalesce(F.col("header"), F.lit("")) != "").distinct().select("file", F.explode(scored).alias("c")).filter("c.score > 0")
    ranked = some.groupBy("file").agg(F.reverse(F.array_sort(F.collect_list("c"))).alias("candidates"))  # columns of one file
    nothing = F.slice(F.col("candidates"), 1, 0)
    fits = lambda taken, c: ~F.exists(taken, lambda x: (x["field"] == c["field"]) | (x["header"] == c["header"]))
    taken = F.aggregate("candidates", nothing, lambda taken, c: F.when(fits(taken, c), F.concat(taken, F.array(c))).otherwise(taken))
    return ranked.select("file", F.explode(taken).alias("c")).select("file", "c.field", "c.header", "c.score")


def missing_fields(headers: DataFrame, mapped: DataFrame) -> DataFrame:
    """file, missing: the required fields that a file has no column for; files that lack none are left out."""
    found = mapped.groupBy("file").agg(F.collect_set("field").alias("found"))
    files = headers.select("file").distinct().join(found, "file", "left")
    missing = F.array_sort(F.array_except(_words(" ".join(REQUIRED)), F.coalesce("found", F.array().cast("array<string>"))))
    return files.select("file", missing.alias("missing")).filter(F.size("missing") > 0)


def check_values(mapped: DataFrame, values: DataFrame) -> DataFrame:
    """file, warning: what the sampled values hold against the mapping.

    values: file, row, header, value (a row's cells). Warnings: `time` no value parses as a time; `loop` source and
    destination are equal in every row; `no outcome` no column tells success; `success` none of its values means success; `one outcome` it
    has one value only.
    """
    cells = values.join(mapped.select("file", "field", "header"), ["file", "header"])
    text = F.trim("value")
    by_row = cells.groupBy("file", "row").agg(*[F.max(F.when(F.col("field") == f, text)).alias(f) for f in ("timestamp", "source_host", "destination_host", "success")])
    held = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    means = F.lower("success").isin(*S.TRUE_WORDS)
    counts = by_row.groupBy("file").agg(
        F.count_if(held("timestamp")).alias("times"),
        F.count_if(held("timestamp") & S.parse_event_time(F.col("timestamp")).isNotNull()).alias("readable"),
        F.count("*").alias("rows"),
        F.count_if(held("source_host") & (F.col("source_host") == F.col("destination_host"))).alias("loops"),
        F.count_if(held("success")).alias("outcomes"),
        F.count_if(held("success") & means).alias("successes"),
        F.count_distinct(F.when(held("success"), F.lower("success"))).alias("kinds"),
    )
    fields = mapped.groupBy("file").agg(F.collect_set("field").alias("fields"))
    has = lambda f: F.array_contains("fields", f)
    rows = counts.join(fields, "file", "right").fillna(0)
    found = F.array(
        F.when(has("timestamp") & (F.col("times") > 0) & (F.col("readable") == 0), "time"),
        F.when(has("source_host") & has("destination_host") & (F.col("rows") > 0) & (F.col("loops") == F.col("rows")), "loop"),
        F.when(~has("success") & (F.col("rows") > 0), "no outcome"),
        F.when(has("success") & (F.col("outcomes") > 0) & (F.col("successes") == 0), "success").when(has("success") & (F.col("kinds") == 1), "one outcome"),
    )
    return rows.select("file", F.explode(F.array_compact(found)).alias("warning"))


def csv_headers(spark: SparkSession, folder: str) -> DataFrame:
    """file, place, header of the CSV files in a folder: the first line of each, found by its offset 0 in the file.

    Quoted headers may hold commas. Files are read as whole lines, so a header is never cut by a split.
    """
    lines = spark.read.text(folder).select("value", F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
    first = lines.filter("at = 0").groupBy("file").agg(F.min_by("value", "n").alias("line"))
    cells = F.regexp_extract_all("line", F.lit(r'("(?:[^"]|"")*"|[^,]*)(,|$)'), F.lit(1))
    return first.select("file", F.posexplode(cells).alias("place", "cell")).select("file", "place", F.regexp_replace(F.regexp_replace("cell", '^"|"$', ""), '""', '"').alias("header")).filter("header <> ''")


def csv_cells(spark: SparkSession, folder: str, headers: DataFrame, rows: int = 200) -> DataFrame:
    """file, row, header, value of at most `rows` lines of each file behind its header, chosen by hash: a sample that only warns."""
    from pyspark.sql import Window

    lines = spark.read.text(folder).select("value", F.input_file_name().alias("file"))
    some = lines.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy(F.xxhash64("value")))).filter(F.col("n") <= rows + 1)
    cells = F.regexp_extract_all("value", F.lit(r'("(?:[^"]|"")*"|[^,]*)(,|$)'), F.lit(1))
    placed = some.select("file", F.col("n").alias("row"), "value", F.posexplode(cells).alias("place", "cell"))
    named = placed.join(F.broadcast(headers), ["file", "place"]).select("file", "row", "header", F.regexp_replace("cell", '^"|"$', "").alias("value"))
    own = named.groupBy("file", "row").agg(F.min((F.col("header") == F.col("value")).cast("int")).alias("is_header"))
    return named.join(own.filter("is_header = 0").select("file", "row"), ["file", "row"])


def read_landing(spark: SparkSession, folder: str, assume_year: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of all CSV exports of a folder, each through the columns inferred for it.

    The files that share a map are read together. A file that lacks a required column is an error that names it.
    """
    headers = csv_headers(spark, folder)
    mapped = infer_column_map(headers.select("file", "header"))
    lacking = missing_fields(headers, mapped).collect()  # one row for each unreadable file
    if lacking:
        raise ValueError(f"no column for {', '.join(lacking[0].missing)} in {lacking[0].file}")
    maps = mapped.groupBy("file").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "header")))).alias("fields"))
    shapes = maps.groupBy(F.to_json("fields").alias("shape")).agg(F.first("fields").alias("fields"), F.collect_list("file").alias("files"))
    out = []
    for shape in shapes.collect():  # one for each kind of export
        rows = spark.read.option("header", "true").csv(list(shape.files))
        out.append(logs.normalize_tabular(rows, dict(shape.fields)))
    events, rejects = out[0]
    for e, r in out[1:]:
        events, rejects = events.unionByName(e), rejects.unionByName(r)
    return events, rejects
