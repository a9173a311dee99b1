"""Column functions over readings: routing, metadata access, text formatting.

All are plain Catalyst expressions (map literals, ``when`` chains, string
functions), so they stay inside whole-stage codegen and work the same on a
batch or a streaming DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _map_literal(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def metric_of(type_col) -> Column:
    """Reading type -> metric; unmapped or missing types give ``unknown``."""
    t = _col(type_col)
    return F.coalesce(F.try_element_at(_map_literal(C.METRIC_BY_TYPE), t), F.lit(C.UNKNOWN_METRIC))


def topic_of(type_col, prefix: str = C.DEVICE_TOPIC_PREFIX) -> Column:
    """Device-side publishing topic ``<prefix>/<metric>``, ``<prefix>/unknown`` otherwise."""
    return F.concat(F.lit(prefix + "/"), metric_of(type_col))


def route_topic(metric_col, prefix: str = C.STREAM_TOPIC_PREFIX) -> Column:
    """Broker topic ``<prefix>.<metric>``."""
    return F.concat(F.lit(prefix + "."), _col(metric_col))


def route_key(user_col) -> Column:
    """Partition key = user id as text, ``anonymous`` when absent."""
    return F.coalesce(_col(user_col).cast("string"), F.lit(C.ANONYMOUS_KEY))


def topic_matches(topic_col, pattern: str) -> Column:
    """MQTT-style filter; ``+`` matches one level, a trailing ``#`` any rest."""
    parts = []
    for i, level in enumerate(pattern.split("/")):
        if level == "+":
            parts.append("[^/]+")
        elif level == "#" and i == len(pattern.split("/")) - 1:
            parts.append(".*")
        else:
            parts.append(_escape(level))
    return _col(topic_col).rlike("^" + "/".join(parts) + "$")


def _escape(text: str) -> str:
    special = set(r".^$*+?{}[]\|()")
    return "".join("\\" + ch if ch in special else ch for ch in text)


def last_segment(topic_col, sep: str = "/") -> Column:
    """Last level of a topic."""
    return F.substring_index(_col(topic_col), sep, -1)


def get_key(map_col, key: str) -> Column:
    """C2 (``->>``): value under ``key`` or null (also for a null map)."""
    return F.try_element_at(_col(map_col), F.lit(key))


def has_key(map_col, key: str) -> Column:
    """C2 (``?``): the map holds ``key``; a null map holds nothing."""
    return F.coalesce(F.map_contains_key(_col(map_col), F.lit(key)), F.lit(False))


def get_key_text(json_col, key: str) -> Column:
    """C2 on JSON text: the value under ``key`` as text, or null."""
    return F.get_json_object(_col(json_col), "$['" + key + "']")


def has_key_text(json_col, key: str) -> Column:
    """C2 on JSON text: the object has ``key`` (with a null value too); other text has no keys."""
    return F.coalesce(F.array_contains(F.json_object_keys(_col(json_col)), key), F.lit(False))


def phase_of(df: DataFrame) -> Column:
    """The sleep phase of a reading: ``metadata['phase']`` (or a ``phase`` column)."""
    if "metadata" in df.columns:
        return get_key("metadata", "phase")
    return F.col("phase")


def short_stage(phase_col) -> Column:
    """Stage text after the last ``Analysis`` (whole text if absent)."""
    return F.substring_index(_col(phase_col), C.STAGE_SPLIT_TOKEN, -1)


def strip_stage_prefix(phase_col) -> Column:
    """A5: anchored removal of the stage prefix."""
    return F.regexp_replace(_col(phase_col), "^" + C.STAGE_PREFIX, "")


def value_text(value_col, places: int) -> Column:
    """Fixed-point text with ``places`` decimals, no grouping separators.

    ``format_number`` with a pattern rounds half-even on the binary value, as
    printf-style ``%.Nf`` does.
    """
    pattern = "0" if places == 0 else "0." + "0" * places
    return F.call_function("format_number", _col(value_col), F.lit(pattern))
