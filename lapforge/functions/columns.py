"""Column functions: text, labels, durations, buckets and projections. All stay inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Track status codes and their names (fixed values).
STATUS_NAMES = {"1": "track_clear", "2": "yellow_flag", "4": "safety_car", "5": "red_flag", "6": "virtual_safety_car_deployed", "7": "virtual_safety_car_ending"}
STATUS_SENTENCES = {"yellow_flag": "Yellow flag", "yellow": "Yellow flag", "safety_car": "Safety car deployed", "red_flag": "Red flag", "red": "Red flag", "virtual_safety_car_deployed": "Virtual safety car deployed", "vsc": "Virtual safety car deployed", "virtual_safety_car_ending": "Virtual safety car ending"}
#: Message labels by the first token set that the text contains (fixed values).
TAXONOMY = [
    ("red_flag", ["red flag", "redflag"]),
    ("safety_car", ["safety car", "safetycar"]),
    ("vsc", ["virtual safety car", " vsc", "vsc "]),
    ("drs", ["drs"]),
    ("penalties", ["penalty", "penalised", "penalized", "time penalty", "drive through", "stop/go"]),
    ("investigations_noted", ["investigat", "noted", "stewards", "summon", "summons", "incident involving"]),
    ("pit_entry_exit", ["pit entry", "pit exit", "pit lane", "pitlane"]),
    ("flags", ["yellow", "green", "blue flag", "double yellow", "clear in sector", "flag"]),
]
#: Quality families by priority (fixed values).
FAMILIES = [("CAR_GAP_TOO_LARGE", "car_gap_too_large"), ("CAR_SAMPLE_TOO_OLD", "car_sample_too_old"), ("LOCATION_GAP_TOO_LARGE", "location_gap_too_large"), ("LOCATION_SAMPLE_TOO_OLD", "location_sample_too_old"), ("OK", "OK")]
#: Corners with names of their own on one circuit (fixed values).
NAMED_CORNERS = {(1, 2): "Turn 1/2, Variante del Rettifilo", (4, 5): "Turn 4/5, Variante della Roggia", (6,): "Turn 6, Lesmo 1", (7,): "Turn 7, Lesmo 2", (8, 9, 10): "Turn 8/9/10, Variante Ascari", (11,): "Turn 11, Parabolica / Alboreto"}
EARTH_RADIUS_M = 6_371_000.0


def first_match(pairs: list[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first condition that holds."""
    out = F.lit(otherwise)
    for condition, value in reversed(pairs):
        out = F.when(condition, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def normalize_message_text(text: Column) -> Column:
    """Lower case, numbers as ``#``, single blanks. Null: empty."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for word in ("car", "driver", "lap", "turn"):
        out = F.regexp_replace(out, rf"\b{word}\s+\d+\b", f"{word} #")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\b\d+\b", "#"), r"\s+", " "))


def message_taxonomy(*parts: Column) -> Column:
    """Label of a message from its category, flag, scope, status and text. "safety car" precedes "virtual safety car"."""
    text = F.lower(F.concat_ws(" ", *(F.coalesce(p, F.lit("")) for p in parts)))
    return first_match([(reduce(Column.__or__, (text.contains(t) for t in tokens)), label) for label, tokens in TAXONOMY], "other")


def format_duration_ms(ms: Column) -> Column:
    """``m:ss.mmm``, or ``s.mmms`` under a minute."""
    minutes, seconds, rest = F.floor(ms / 60000), F.floor((ms % 60000) / 1000), ms % 1000
    long = F.concat(minutes.cast("string"), F.lit(":"), F.lpad(seconds.cast("string"), 2, "0"), F.lit("."), F.lpad(rest.cast("string"), 3, "0"))
    short = F.concat(seconds.cast("string"), F.lit("."), F.lpad(rest.cast("string"), 3, "0"), F.lit("s"))
    return F.when(minutes > 0, long).otherwise(short)


def corner_label(session_id: Column, number: Column, letter: Column) -> Column:
    named = F.lower(session_id).contains("italian-grand-prix") | F.lower(session_id).contains("monza")
    generic = F.concat(F.lit("Turn "), number.cast("string"), F.coalesce(letter, F.lit("")))
    return F.when(number.isNull(), None).otherwise(first_match([(named & number.isin(*ns), label) for ns, label in NAMED_CORNERS.items()] + [(F.lit(True), generic)]))


def status_name(code: Column) -> Column:
    return first_match([(code == k, v) for k, v in STATUS_NAMES.items()], "unknown")


def status_sentence(name: Column) -> Column:
    return first_match([(name == k, v) for k, v in STATUS_SENTENCES.items()] + [(F.lit(True), name)])


def time_bucket(ms: Column, width: int) -> Column:
    """Start of the bucket that holds ``ms``."""
    return (F.floor(ms / width) * width).cast("long")


def quality_family(flags: Column) -> Column:
    return first_match([(F.array_contains(flags, k), v) for k, v in FAMILIES], "other_unknown")


def quality_status(messages: Column) -> Column:
    """invalid, incomplete, valid_with_warnings or valid by the messages' beginnings."""
    return (
        F.when(F.exists(messages, lambda m: m.startswith("INVALID_")), "invalid")
        .when(F.exists(messages, lambda m: m.startswith("INCOMPLETE_")), "incomplete")
        .when(F.size(messages) > 0, "valid_with_warnings")
        .otherwise("valid")
    )


def event_label(speed: Column, throttle: Column, brake: Column, drs: Column) -> Column:
    """First match of hard braking, high speed, DRS and throttle lift; null for none."""
    return F.when(brake >= 80, "hard_braking").when(speed >= 300, "high_speed").when(drs > 0, "drs_active").when((throttle <= 10) & (speed >= 150), "throttle_lift")


def project_xy(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Equirectangular metres around an origin."""
    return F.radians(lon - lon0) * EARTH_RADIUS_M * F.cos(F.radians(lat0)), F.radians(lat - lat0) * EARTH_RADIUS_M


def unproject_xy(x: Column, y: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    return F.degrees(y / EARTH_RADIUS_M) + lat0, F.degrees(x / (EARTH_RADIUS_M * F.cos(F.radians(lat0)))) + lon0


def insight(kind: str, text: Column, value: Column, unit: str) -> Column:
    return F.struct(F.lit(kind).alias("type"), text.alias("text"), value.cast("double").alias("value"), F.lit(unit).alias("unit"))


def insights(*pairs: tuple[Column, Column]) -> Column:
    """Array of the insights whose condition holds."""
    return F.filter(F.array(*(F.when(c, i) for c, i in pairs)), lambda x: x.isNotNull())
