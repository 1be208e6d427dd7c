"""JSON projections: decode, encode, topic tagging, field access."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def json_decode(value, strict: bool = False) -> Column:
    """bytes/text -> VARIANT. Null stays null. ``strict`` raises on malformed
    text (like the plain deserializer); otherwise malformed -> null, which is
    what the service consumers do by logging and skipping."""
    v = _c(value)
    return F.parse_json(v) if strict else F.try_parse_json(v)


def json_encode(*cols) -> Column:
    """Object -> compact JSON text; a null object stays null."""
    if len(cols) == 1:
        s = _c(cols[0])
        return F.when(s.isNotNull(), F.to_json(s))
    return F.to_json(F.struct(*[_c(c) for c in cols]))


def topic_tag_with_fallback(value, topic) -> Column:
    """The dashboard payload: the JSON object with ``_topic`` set
    (overwriting a field of that name), or ``{message: raw, _topic}`` when
    the text is not a JSON object (malformed, null, array, scalar)."""
    v, t = _c(value), _c(topic)
    # one parse per row: the map form is null for malformed text; the
    # leading-brace test separates objects from arrays and scalars
    fields = F.from_json(v, "map<string,variant>")
    obj = F.coalesce(fields.isNotNull() & v.rlike(r"^\s*\{"), F.lit(False))
    kept = F.map_filter(fields, lambda k, _: k != F.lit("_topic"))
    topic_v = F.variant_get(F.parse_json(F.to_json(F.array(t))), "$[0]", "variant")
    tagged = F.to_json(F.map_concat(kept, F.create_map(F.lit("_topic"), topic_v)))
    # the raw text is kept even when null: {"message": null, "_topic": ...}
    fallback = F.to_json(F.struct(v.alias("message"), t.alias("_topic")), {"ignoreNullFields": "false"})
    return F.when(obj, tagged).otherwise(fallback)


def nonblank_text_field(value, field: str) -> Column:
    """Field of a JSON object as text; missing, JSON null or blank -> null.
    A non-blank value is returned untrimmed."""
    s = F.get_json_object(_c(value), f"$.{field}")
    return F.when(F.regexp_replace(s, r"\s", "") != "", s)


def safe_epoch(value, field: str = "timestamp") -> Column:
    """Payload timestamp as epoch ms; missing or non-numeric -> null (the
    row is then skipped by the caller). ANSI mode stays on: try_cast."""
    s = F.get_json_object(_c(value), f"$.{field}")
    return s.try_cast("bigint")
