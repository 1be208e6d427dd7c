"""Text, id and outcome projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from blockyard import constants as K


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def java_trim(col) -> Column:
    """Trim every char <= U+0020 at both ends (Java ``String.trim``)."""
    return F.regexp_replace(_c(col), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def nonblank(col) -> Column:
    """The value, or null when null / blank."""
    c = _c(col)
    return F.when(F.regexp_replace(c, r"\s", "") != "", c)


def enum_normalise(col, allowed: list[str]) -> Column:
    """Exact match, else trim + upper-case match; unknown or blank -> null
    (invalid)."""
    c = _c(col)
    fixed = F.upper(java_trim(c))
    return (F.when(c.isin(*allowed), c)
            .when(fixed.isin(*allowed), fixed))


def uuid_from_hash(seed) -> Column:
    """Deterministic 8-4-4-4-12 id from md5 of a seed (reruns agree, unlike
    ``uuid()``)."""
    h = F.md5(_c(seed).cast("string"))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4),
                       F.substring(h, 13, 4), F.substring(h, 17, 4),
                       F.substring(h, 21, 12))


def id_defaults(existing, business_key, seed) -> Column:
    """First non-blank of the existing id and the business key, else a
    generated id (hash of ``seed``)."""
    return F.coalesce(nonblank(existing), nonblank(business_key), uuid_from_hash(seed))


def event_step(message, is_error, info_title=None) -> Column:
    """Dashboard step detection -> ``struct(step INT, failed BOOLEAN)`` or
    null when no rule matches. First matching rule wins."""
    title = F.lower(F.coalesce(_c(info_title), F.lit(""))) if info_title is not None else F.lit("")
    text = F.concat(title, F.lit(" "), F.lower(F.coalesce(_c(message), F.lit(""))))
    err = F.coalesce(_c(is_error), F.lit(False))

    def has(*words):
        cond = F.lit(False)
        for w in words:
            cond = cond | text.contains(w)
        return cond

    def st(step, failed):
        return F.struct(F.lit(step).cast("int").alias("step"), F.lit(failed).alias("failed"))

    return (F.when(err & has("manufactur", "restock", "restore"), st(3, True))
            .when(err & has("inventor"), st(1, True))
            .when(err, st(3, True))
            .when(has("complete", "finish", "deliver"), st(3, False))
            .when(has("manufactur", "production", "robot"), st(2, False))
            .when(has("reserv", "inventor"), st(1, False))
            .when(has("order") & has("receiv"), st(0, False)))


def item_type_from_text(message, info_text=None) -> Column:
    """First whole word CHAIR/TABLE/SHELF/CLOSET in any case, upper-cased."""
    extra = F.coalesce(_c(info_text), F.lit("")) if info_text is not None else F.lit("")
    text = F.concat(F.coalesce(_c(message), F.lit("")), F.lit(" "), extra)
    pattern = r"(?i)\b(" + "|".join(K.ITEM_TYPES) + r")\b"
    hit = F.upper(F.regexp_extract(text, pattern, 1))
    return F.when(hit != "", hit)


def uuid_valid(col) -> Column:
    """8-4-4-4-12 hex, any case."""
    return F.coalesce(
        _c(col).rlike(r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"),
        F.lit(False))


def time_label(ts) -> Column:
    """``HH:mm:ss.SSS``; null -> empty text."""
    return F.coalesce(F.date_format(_c(ts), "HH:mm:ss.SSS"), F.lit(""))


def epoch_ms(ts) -> Column:
    """Epoch milliseconds of a TIMESTAMP_NTZ (wall clock taken as UTC)
    without going through the session time zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                            _c(ts).cast("timestamp_ntz"))


def key_partition(key, num_partitions: int | None = None) -> Column:
    """Partition number = integer value of the text key; null or non-numeric
    key (or out of range when ``num_partitions`` is given) -> null."""
    p = _c(key).cast("string").try_cast("int")
    if num_partitions is not None:
        p = F.when((p >= 0) & (p < num_partitions), p)
    return p


def reservation_outcome(status) -> Column:
    """HTTP status of a reservation -> ``struct(success, failure_type,
    technical)``: 2xx success; 409 insufficient (not technical); anything
    else technical. Null status (request never sent) is technical."""
    s = _c(status)
    ok = (s >= 200) & (s < 300)
    return F.struct(
        F.coalesce(ok, F.lit(False)).alias("success"),
        F.when(ok, F.lit(None).cast("string"))
         .when(s == 409, F.lit(K.INSUFFICIENT_BLOCKS))
         .otherwise(F.lit(K.TECHNICAL_OR_INVALID)).alias("failure_type"),
        F.when(ok, F.lit(False)).when(s == 409, F.lit(False)).otherwise(F.lit(True)).alias("technical"),
    )


# --- fixed values: user-facing message texts by outcome kind ---------------
OUTCOME_TEXTS = {
    "reservation_error": ("Inventory service unavailable: ",
                          "Inventory service unavailable during reservation."),
    "reservation_info": ("Reservation not possible: ",
                         "Reservation not possible due to insufficient inventory."),
    "fetch_error": ("Inventory fetch failed: ",
                    "Inventory fetch failed in factory workflow."),
}
RESTORE_BASES = {
    "AFTER_TIMEOUT": "Inventory restore failed after manufacturing timeout",
    "AFTER_FACTORY_ERROR": "Inventory restore failed after factory error",
}
RESTORE_DEFAULT = "Inventory restore failed"


def outcome_message(kind, detail, stage=None) -> Column:
    """User text per outcome kind, with the detail appended when non-blank.
    ``kind`` is one of the keys above or ``restore_error`` (uses ``stage``;
    a null or unknown stage takes the default text)."""
    k, d = _c(kind), nonblank(detail)
    expr = None
    for name, (prefix, fallback) in OUTCOME_TEXTS.items():
        txt = F.when(d.isNotNull(), F.concat(F.lit(prefix), d)).otherwise(F.lit(fallback))
        expr = (F.when(k == name, txt) if expr is None else expr.when(k == name, txt))
    st = _c(stage) if stage is not None else F.lit(None).cast("string")
    base = F.lit(RESTORE_DEFAULT)
    for s, b in reversed(list(RESTORE_BASES.items())):
        base = F.when(st == s, F.lit(b)).otherwise(base)
    restore = F.when(d.isNotNull(), F.concat(base, F.lit(": "), d)).otherwise(F.concat(base, F.lit(".")))
    return expr.when(k == "restore_error", restore)


def failure_stage(activity_id) -> Column:
    """Activity id -> ``struct(stage, error_code)`` with default."""
    a = _c(activity_id)
    stage = F.lit(K.FAILURE_STAGE_DEFAULT[0])
    code = F.lit(K.FAILURE_STAGE_DEFAULT[1])
    for act, s, c in reversed(K.FAILURE_STAGES):
        stage = F.when(a == act, F.lit(s)).otherwise(stage)
        code = F.when(a == act, F.lit(c)).otherwise(code)
    return F.struct(stage.alias("stage"), code.alias("error_code"))
