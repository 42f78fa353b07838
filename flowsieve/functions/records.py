"""Column expressions on flow records: text form, fingerprint, scope, time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Accepted column names per logical column, first present wins.
SOURCE = ("Source IP", "Src IP", "src_ip", "source_ip")
DESTINATION = ("Destination IP", "Dst IP", "dst_ip", "destination_ip")
FWD_BYTES = ("Total Length of Fwd Packets", "Fwd Bytes", "fwd_bytes")
TENANT = ("tenant_id", "Tenant ID", "Source IP", "Src IP", "src_ip")
LOG_TYPE = ("log_type", "Log Type", "Protocol", "protocol")
DST_PORT = ("Destination Port",)
BWD_PACKETS = ("Total Backward Packets",)
EVENT_TIME = ("Timestamp",)

# The wide fingerprint, for records that differ in port or volume.
NINE_FIELDS = (
    "Source IP",
    "Destination IP",
    "Source Port",
    "Destination Port",
    "Protocol",
    "Total Fwd Packets",
    "Total Backward Packets",
    "Total Length of Fwd Packets",
    "Total Length of Bwd Packets",
)

# Day-first patterns tried in order, then the ISO forms.
TIME_PATTERNS = (
    "d/M/yyyy H:mm:ss",
    "d/M/yyyy H:mm",
    "d/M/yyyy h:mm:ss a",
    "d/M/yyyy h:mm a",
    "d-M-yyyy H:mm:ss",
    "d-M-yyyy H:mm",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm",
)

SCOPE = ("tenant", "log_type")


def column_name(df: DataFrame, names: Sequence[str]) -> str | None:
    """The first of `names` that the frame has, decided once per schema."""
    return next((n for n in names if n in df.columns), None)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def as_text(df: DataFrame, name: str | None) -> Column:
    """Text form of a column; absent, null and NaN are the empty string.

    Whole doubles print as integers, so 1e7 reads the same in every engine.
    """
    if name is None:
        return F.lit("")
    col = quoted(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        whole = (col == F.floor(col)) & (F.abs(col) < F.lit(9.0e15))
        text = (
            F.when(F.isnan(col), F.lit(""))
            .when(whole, col.cast("bigint").cast("string"))
            .otherwise(col.cast("string"))
        )
    else:
        text = col.cast("string")
    return F.coalesce(text, F.lit(""))


def fingerprint(df: DataFrame, columns: Sequence[str | None], delimiter: str = "|") -> Column:
    """SHA-256 (32 bytes) over the delimited text of `columns`.

    Bytes, not hex digits: half the width in every shuffle and saved window.
    """
    return F.unhex(F.sha2(F.concat_ws(delimiter, *[as_text(df, c) for c in columns]), 256))


def hex_digits(fp: Column) -> Column:
    """The fingerprint as 64 lower-case hex digits."""
    return F.lower(F.hex(fp))


def flow_fingerprint(df: DataFrame, delimiter: str = "|") -> Column:
    """Fingerprint of source, destination and forward bytes.

    A `_dedupe_fp` column takes precedence where it is not null: a digest, as
    32 bytes or 64 hex digits, is taken as it is, any other value is hashed so
    that every fingerprint has the same form.
    """
    named = [column_name(df, n) for n in (SOURCE, DESTINATION, FWD_BYTES)]
    computed = fingerprint(df, named, delimiter)
    if "_dedupe_fp" in df.columns:
        return F.coalesce(carried_digest(df, "_dedupe_fp"), computed)
    return computed


def carried_digest(df: DataFrame, name: str) -> Column:
    """The 32-byte digest that a column carries, or that of its value."""
    given = F.col(name)
    if isinstance(df.schema[name].dataType, T.BinaryType):
        return digest_bytes(given)
    text = given.cast("string")
    return F.when(text.rlike("^[0-9a-fA-F]{64}$"), F.unhex(text)).otherwise(F.unhex(F.sha2(text, 256)))


def digest_bytes(fp: Column) -> Column:
    """A fingerprint of 32 bytes as it is, one of any other length hashed to 32."""
    return F.when(F.octet_length(fp) == 32, fp).otherwise(F.unhex(F.sha2(fp, 256)))


def scope_columns(df: DataFrame, tenant_from_source_ip: bool = True) -> tuple[Column, Column]:
    """(tenant, log_type); the first column that exists decides, even if null.

    `source_ip` is not among the tenant names of the original rules, so such
    tables share one tenant there. It counts here unless switched off.
    """
    names = TENANT + (("source_ip",) if tenant_from_source_ip else ())
    tenant = as_text(df, column_name(df, names))
    log_type = as_text(df, column_name(df, LOG_TYPE))
    if "_dedupe_scope" in df.columns:  # struct<tenant, log_type>
        given = F.col("_dedupe_scope")
        tenant = F.coalesce(given["tenant"], tenant)
        log_type = F.coalesce(given["log_type"], log_type)
    return tenant, log_type


def flow_view(df: DataFrame, seq: str = "seq", delimiter: str = "|", keep: Sequence[str] = ()) -> DataFrame:
    """Narrow dedupe view: `seq`, scope, fingerprint, and any `keep` columns."""
    tenant, log_type = scope_columns(df)
    return df.select(
        quoted(seq).alias("seq"),
        tenant.alias("tenant"),
        log_type.alias("log_type"),
        flow_fingerprint(df, delimiter).alias("fp"),
        *[quoted(c) for c in keep],
    )


def parse_event_time(col: Column) -> Column:
    """Timestamp of a day-first text in one of several forms; else null."""
    text = F.trim(col)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in TIME_PATTERNS])


def is_finite(col: Column) -> Column:
    value = col.cast("double")
    return col.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def clean_flows(df: DataFrame, numeric: Sequence[str], event_time: str | None = None) -> DataFrame:
    """Keep rows whose numeric columns are finite and whose time is known.

    No aggregation and no removal of repeats: later steps count those.
    """
    keep = F.lit(True)
    for name in numeric:
        keep = keep & is_finite(quoted(name))
    if event_time is not None:
        keep = keep & quoted(event_time).isNotNull()
    return df.where(keep)


def md5_slot(key: Column, slots: int) -> Column:
    """The 128-bit md5 number of `key` modulo `slots`, exactly.

    The digest is folded in groups of 28 bits, so no product passes 2^63 for
    `slots` below 2^35.
    """
    digest = F.md5(key)
    value = F.lit(0).cast("bigint")
    for start in range(0, 32, 7):
        width = min(7, 32 - start)
        digits = F.conv(F.substring(digest, start + 1, width), 16, 10).cast("bigint")
        value = (value * F.lit(16**width) + digits) % F.lit(slots)
    return value.cast("int")


def floor_div(a: Column, b: int) -> Column:
    """a / b rounded down, in integers (a double would not tell large neighbours apart)."""
    divisor = F.lit(b).cast("bigint")
    return F.call_function("div", a - F.pmod(a, divisor), divisor)


def hash_number(*parts: Column) -> Column:
    """A repeatable 60-bit number from parts, equal in any engine with md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("bigint")
