"""Scalar functions of authentication logs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What logs write for accounts of the system itself, and the names of numeric logon codes.
NOISE_ACCOUNTS = ("SYSTEM", "LOCAL SERVICE", "NETWORK SERVICE", "ANONYMOUS LOGON", "-", "")
LOGON_NAMES = {2: "Interactive", 3: "Network", 4: "Batch", 5: "Service", 7: "Unlock", 8: "NetworkCleartext", 9: "NewCredentials", 10: "RemoteInteractive", 11: "CachedInteractive"}
TRUE_WORDS = ("true", "1", "yes", "y", "success", "succeeded", "ok", "accept", "accepted", "allow")


def parse_event_time(c: Column, assume_year: int | None = None) -> Column:
    """Epoch seconds of epoch seconds or milliseconds (above 1e11), ISO stamps with Z, offset or fraction, plain date-times
    (UTC), and with a given year `Mon dd hh:mm:ss`; null if none fits."""
    text = F.trim(c.cast("string"))
    number = F.when(text.rlike(r"^\d{9,13}$"), text.cast("long"))
    iso = F.regexp_replace(F.regexp_replace(text, r"^(\d{4}-\d\d-\d\d)[ T]", "$1T"), r"(\.\d{1,6})\d*", "$1")
    iso = F.when(text.rlike(r"^\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:?\d\d)?$"), F.when(iso.rlike(r"(Z|[+-]\d\d:?\d\d)$"), iso).otherwise(F.concat(iso, F.lit("Z"))))
    found = [F.when(number > 100_000_000_000, F.floor(number / 1000)).otherwise(number), F.unix_seconds(F.try_to_timestamp(iso))]
    if assume_year is not None:
        short = F.when(text.rlike(r"^[A-Z][a-z]{2} +\d{1,2} \d\d:\d\d:\d\d$"), F.concat(F.lit(f"{assume_year} "), F.regexp_replace(text, " +", " ")))
        found.append(F.unix_seconds(F.try_to_timestamp(short, F.lit("yyyy MMM d HH:mm:ss"))))
    return F.coalesce(*found).cast("long")


def canonical_host(c: Column) -> Column:
    """An address kept as it is (loopback and unspecified: empty), else the name before @, domain and $, in upper case."""
    text = F.trim(F.coalesce(c, F.lit("")))
    ip = F.regexp_replace(F.lower(text), r"^::ffff:", "")
    is_ip = ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | ip.contains(":")
    name = F.upper(F.regexp_replace(F.split_part(F.split_part(text, F.lit("@"), F.lit(1)), F.lit("."), F.lit(1)), r"\$$", ""))
    return F.when(ip.isin("::1", "::", "0.0.0.0") | ip.startswith("127."), "").when(is_ip, F.upper(ip)).otherwise(name)


def canonical_user(user: Column, domain: Column) -> Column:
    """user@REALM, from user and domain, user@realm or DOMAIN\\user."""
    text = F.trim(F.coalesce(user, F.lit("")))
    at, back = F.instr(text, "@") > 0, F.instr(text, "\\") > 0
    name = F.when(at, F.split_part(text, F.lit("@"), F.lit(1))).when(back, F.substring_index(text, "\\", -1)).otherwise(text)
    realm = F.when(at, F.split_part(text, F.lit("@"), F.lit(2))).when(back, F.substring_index(text, "\\", 1)).otherwise(F.coalesce(domain, F.lit("")))
    realm = F.upper(F.split_part(realm, F.lit("."), F.lit(1)))
    return F.when(realm == "", F.lower(name)).otherwise(F.concat(F.lower(name), F.lit("@"), realm))


def is_noise_account(c: Column) -> Column:
    return F.upper(F.split_part(F.coalesce(c, F.lit("")), F.lit("@"), F.lit(1))).isin(*NOISE_ACCOUNTS)


def service_host(c: Column) -> Column:
    """The host of a service principal service/host@REALM, else empty."""
    principal = F.split_part(F.coalesce(c, F.lit("")), F.lit("@"), F.lit(1))
    return F.when(F.instr(principal, "/") > 0, canonical_host(F.substring_index(principal, "/", -1))).otherwise("")


def logon_code_name(c: Column) -> Column:
    out = F.lit("Network")
    for code, name in LOGON_NAMES.items():
        out = F.when(c == code, name).otherwise(out)
    return out


def parse_success(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string"))).isin(*TRUE_WORDS).cast("int")


def canonical_auth(c: Column) -> Column:
    """Kerberos, NTLM (also by the names of its Windows package), Negotiate or Other."""
    x = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    ntlm = x.contains("ntlm") | x.startswith("microsoft_authentication") | x.isin("msv1_0", "msv")
    return F.when(x.contains("kerberos"), "Kerberos").when(ntlm, "NTLM").when(x.contains("negotiate"), "Negotiate").otherwise("Other")


# The spellings of logon types, without blanks and underscores, and the orientations.
LOGON_WORDS = {
    "network": "network networkcleartext 3 8",
    "interactive": "interactive cachedinteractive unlock 2 7 11",
    "remote_interactive": "remoteinteractive 10",
    "service_batch": "service batch 4 5",
}
ORIENTATIONS = "logon tgs tgt authmap"


def canonical_logon(c: Column) -> Column:
    x = F.regexp_replace(F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))), "[ _]", "")
    out = F.lit("other")
    for word, spellings in LOGON_WORDS.items():
        out = F.when(x.isin(*spellings.split()), word).otherwise(out)
    return out


def canonical_orientation(c: Column) -> Column:
    x = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(x.isin(*ORIENTATIONS.split()), x).otherwise("other")


#: Columns of the block of categories, in order.
CATEGORY_BLOCK = {"auth": "kerberos ntlm negotiate other", "logon": "network interactive remote_interactive service_batch other", "orientation": "logon tgs tgt authmap other"}


def category_block(auth: Column, logon: Column, orientation: Column, success: Column) -> dict[str, Column]:
    """Fifteen 0/1 columns: one of each vocabulary's words, and success."""
    words = {"auth": F.lower(canonical_auth(auth)), "logon": canonical_logon(logon), "orientation": canonical_orientation(orientation)}
    out = {f"{kind}_{w}": (words[kind] == w).cast("int") for kind, all_words in CATEGORY_BLOCK.items() for w in all_words.split()}
    return out | {"success": success.cast("int")}


def machine_account(c: Column) -> Column:
    return F.split_part(c, F.lit("@"), F.lit(1)).endswith("$").cast("int")


def ramp(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c - lo) / (hi - lo)))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def saturate(c: Column) -> Column:
    return 1 - F.exp(-c)


def decay(age: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), age / half_life)


def oov_bucket(kind: str, value: Column, capacity: int, buckets: int) -> Column:
    """capacity + the first eight bytes of sha256(kind, 0, value), modulo buckets."""
    head = F.substring(F.sha2(F.concat(F.lit(kind + "\0"), value), 256), 1, 16)
    return (F.lit(capacity) + F.pmod(F.conv(head, 16, 10).cast("decimal(20,0)"), F.lit(buckets).cast("decimal(20,0)"))).cast("long")


SEVERITY = {"intelligence": ((0.9, "critical"), (0.75, "high"), (0.5, "medium")), "console": ((0.85, "critical"), (0.70, "high"), (0.50, "medium"))}


def severity(c: Column, scale: str) -> Column:
    out = F.lit("low")
    for bound, name in reversed(SEVERITY[scale]):
        out = F.when(c >= bound, name).otherwise(out)
    return out


def incident_severity(risk: Column, escalated: Column, above_gate: Column) -> Column:
    """The band of an account's incident: critical if it was escalated or the gate's alerts reach 0.9, high with any alert above the gate."""
    gated = F.coalesce(above_gate > 0, F.lit(False))
    return F.when(F.coalesce(escalated, F.lit(False)) | (gated & (risk >= 0.9)), "critical").when(gated, "high").when(risk >= 0.5, "medium").otherwise("low")
