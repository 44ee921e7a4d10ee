"""Mixed timestamp forms and zones to one unambiguous form, as one JVM-side expression.

The cascade is a list of anchored patterns, tried in order; the first pattern that matches decides, and its parts are
then parsed strictly (an impossible part gives null, it never falls through to a laxer pattern).

Defined results: null, blank, placeholder and impossible values give null; white space around a value is ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import once

# Month names and their common short forms in the seven languages of the corpora.
MONTHS = {
    1: "january jan januar janvier janv enero ene gennaio gen januari janeiro",
    2: "february feb februar février fevrier févr febrero febbraio februari fevereiro fev",
    3: "march mar märz maerz mär mars marzo maart mrt março marco",
    4: "april apr avril avr abril abr aprile",
    5: "may mai mayo maggio mag mei maio",
    6: "june jun juni juin junio giugno giu junho",
    7: "july jul juli juillet juil julio luglio lug julho",
    8: "august aug août aout agosto ago augustus",
    9: "september sep sept septembre septiembre settembre set setembro",
    10: "october oct oktober okt octobre octubre ottobre ott outubro out",
    11: "november nov novembre noviembre novembro",
    12: "december dec dezember dez décembre decembre déc diciembre dic dicembre dezembro",
}
# Minutes east of UTC of zone abbreviations. CST and IST have several meanings: see HOMONYMS.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MET": 60, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "PKT": 300, "SGT": 480, "HKT": 480, "AWST": 480, "JST": 540, "KST": 540,
    "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "BRT": -180, "ART": -180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
# Fixed values: (abbreviation, start of the site's zone) with another meaning there.
HOMONYMS = {("CST", "Asia/"): 480, ("IST", "Europe/Dublin"): 60, ("IST", "Asia/Jerusalem"): 120, ("AST", "Asia/"): 180}
# Languages of the source that write the month before the day between slashes.
MONTH_FIRST = ("en-US",)

_MON = r"([\p{L}]{3,10})\.?"
_T = r"(\d{1,2}):(\d{2})"
_OFF = r"(Z|z|[+-]\d{2}:?\d{2})"
_FRAC = r"(?:[.,]\d{1,9})?"


@dataclass(frozen=True)
class Form:
    """One pattern; parts names its groups: y mo(th) mon(name) d h mi s ap(am or pm) off(set) abb(reviation) a b (day or month by locale) ep(och)."""

    name: str
    pattern: str
    parts: str


# Fixed order: a form comes before any other form that could also match its values.
FORMS = [
    Form("epoch_ms", r"^(\d{13})$", "ems"),
    Form("epoch_s", r"^(\d{10})$", "ep"),
    Form("iso_offset", rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})[T ]{_T}:(\d{{2}}){_FRAC} ?{_OFF}$", "y mo d h mi s off"),
    Form("iso_offset_minute", rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})[T ]{_T} ?{_OFF}$", "y mo d h mi off"),
    Form("iso_abbreviation", rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})[T ]{_T}:(\d{{2}}){_FRAC} ([A-Za-z]{{2,5}})$", "y mo d h mi s abb"),
    Form("iso_local", rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})[T ]{_T}:(\d{{2}}){_FRAC}$", "y mo d h mi s"),
    Form("iso_local_minute", rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})[T ]{_T}$", "y mo d h mi"),
    Form("iso_day", r"^(\d{4})-(\d{1,2})-(\d{1,2})$", "y mo d"),
    Form("iso_month", r"^(\d{4})-(\d{1,2})$", "y mo"),
    Form("basic_offset", rf"^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}}){_FRAC}{_OFF}$", "y mo d h mi s off"),
    Form("basic_local", rf"^(\d{{4}})(\d{{2}})(\d{{2}})T?(\d{{2}})(\d{{2}})(\d{{2}}){_FRAC}$", "y mo d h mi s"),
    Form("basic_day", r"^(\d{4})(\d{2})(\d{2})$", "y mo d"),
    Form("pdf_offset", r"^D:(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})(Z|[+-]\d{2}'?\d{2})'?(?:00'00'?)?$", "y mo d h mi s off"),
    Form("pdf_local", r"^D:(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$", "y mo d h mi s"),
    Form("pdf_local_minute", r"^D:(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})$", "y mo d h mi"),
    Form("pdf_day", r"^D:(\d{4})(\d{2})(\d{2})$", "y mo d"),
    Form("pdf_month", r"^D:(\d{4})(\d{2})$", "y mo"),
    Form("pdf_year", r"^D:(\d{4})$", "y"),
    Form("slash_ymd", r"^(\d{4})/(\d{1,2})/(\d{1,2})$", "y mo d"),
    Form("slash_ymd_time", rf"^(\d{{4}})/(\d{{1,2}})/(\d{{1,2}}) {_T}(?::(\d{{2}}){_FRAC})?$", "y mo d h mi s"),
    Form("slash_day", r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "a b y"),
    Form("slash_12h", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),? {_T}(?::(\d{{2}}){_FRAC})? ?([AaPp])\.?[Mm]\.?$", "a b y h mi s ap"),
    Form("slash_24h", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),? {_T}(?::(\d{{2}}){_FRAC})?$", "a b y h mi s"),
    Form("slash_month", r"^(\d{1,2})/(\d{4})$", "mo y"),
    Form("dot_day", r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", "d mo y"),
    Form("dot_time", rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),? {_T}(?::(\d{{2}}){_FRAC})?$", "d mo y h mi s"),
    Form("dot_month", r"^(\d{1,2})\.(\d{4})$", "mo y"),
    Form("log", rf"^(\d{{1,2}})/{_MON}/(\d{{4}}):{_T}:(\d{{2}}) ?{_OFF}$", "d mon y h mi s off"),
    Form("mail", rf"^(?:[A-Za-z]{{3}}, )?(\d{{1,2}}) {_MON} (\d{{4}}) {_T}:(\d{{2}}) {_OFF}$", "d mon y h mi s off"),
    Form("day_first_abbreviation", rf"^(\d{{1,2}}) {_MON} (\d{{4}}),? {_T}(?::(\d{{2}}){_FRAC})? ([A-Za-z]{{1,5}})$", "d mon y h mi s abb"),
    Form("day_first_local", rf"^(\d{{1,2}}) {_MON} (\d{{4}}),? {_T}(?::(\d{{2}}){_FRAC})?$", "d mon y h mi s"),
    Form("month_first_abbreviation", rf"^{_MON} (\d{{1,2}}),? (\d{{4}}),? {_T}(?::(\d{{2}}){_FRAC})? ([A-Za-z]{{1,5}})$", "mon d y h mi s abb"),
    Form("month_first_local", rf"^{_MON} (\d{{1,2}}),? (\d{{4}}),? {_T}(?::(\d{{2}}){_FRAC})?$", "mon d y h mi s"),
    Form("hyphen_name", rf"^(\d{{1,2}})-{_MON}-(\d{{4}})$", "d mon y"),
    Form("day_name", rf"^(\d{{1,2}})(?:st|nd|rd|th|er|º|°|\.)? (?:de |of )?{_MON},?(?: de| del)? (\d{{4}})$", "d mon y"),
    Form("name_day", rf"^{_MON} (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})$", "mon d y"),
    Form("name_month", rf"^{_MON},?(?: de| of)? (\d{{4}})$", "mon y"),
    Form("year", r"^(\d{4})$", "y"),
]


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for k, v in pairs.items() for x in (k, v)])


def _offset_minutes(text: Column) -> Column:
    digits = F.regexp_replace(text, "[^0-9]", "")
    sign = F.when(text.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    hours, minutes = F.substring(digits, 1, 2).try_cast("int"), F.substring(digits, 3, 2).try_cast("int")
    return F.when(F.upper(text) == "Z", F.lit(0)).when((hours <= 18) & (minutes < 60), sign * (hours * 60 + minutes))


def _abbreviation_minutes(text: Column, zone: Column) -> Column:
    name = F.upper(text)
    out = F.try_element_at(_literal_map(ABBREVIATIONS), name)
    for (abb, start), minutes in HOMONYMS.items():
        out = F.when((name == abb) & zone.startswith(start), F.lit(minutes)).otherwise(out)
    return out


#: The slots of the common notation that every form is rewritten to before its parts are read.
SLOTS = ["form", *"y mo mon d h mi s ap off abb a b ep ems".split()]


def common_notation(value: Column, forms: list[Form] = FORMS) -> Column:
    """The parts of the first form that matches, as text of SLOTS parted by bars; null if no form matches."""
    out = None
    for form in reversed(forms):
        at = {part: f"${i + 1}" for i, part in enumerate(form.parts.split())}
        parts = "|".join([form.name, *(at.get(slot, "") for slot in SLOTS[1:])])
        rewritten = F.regexp_replace(value, form.pattern, parts)
        hit = F.regexp_like(value, F.lit(form.pattern))
        out = F.when(hit, rewritten) if out is None else F.when(hit, rewritten).otherwise(out)
    return out


def parsed(parts: Column, zone: Column, locale: Column) -> Column:
    """The slots as a struct: form, y, mo, d, h, mi, s (int), off (minutes), zoned, ep (seconds)."""
    text = {slot: F.get(parts, F.lit(i)) for i, slot in enumerate(SLOTS)}
    num = {slot: text[slot].try_cast("int") for slot in ("y", "mo", "d", "h", "mi", "s", "a", "b")}
    months = _literal_map({name: number for number, names in MONTHS.items() for name in names.split()})
    us = locale.isin(*MONTH_FIRST)
    named, slashed = text["mon"] != "", text["a"] != ""
    month = F.when(named, F.coalesce(F.try_element_at(months, F.lower(text["mon"])), F.lit(0))).when(slashed, F.when(us, num["a"]).otherwise(num["b"])).otherwise(num["mo"])
    day = F.when(slashed, F.when(us, num["b"]).otherwise(num["a"])).otherwise(num["d"])
    hour12 = F.when(num["h"].between(1, 12), num["h"] % 12 + F.when(F.lower(text["ap"]) == "p", 12).otherwise(0)).otherwise(F.lit(99))
    offset = F.when(text["off"] != "", _offset_minutes(text["off"])).when(text["abb"] != "", _abbreviation_minutes(text["abb"], zone))
    epoch = F.coalesce(text["ep"].try_cast("bigint"), F.floor(text["ems"].try_cast("bigint") / 1000).cast("bigint"))
    return F.struct(
        text["form"].alias("form"), num["y"].alias("y"), month.cast("int").alias("mo"), day.alias("d"),
        F.when(text["ap"] != "", hour12).otherwise(num["h"]).cast("int").alias("h"), num["mi"].alias("mi"), F.coalesce(num["s"], F.lit(0)).alias("s"),
        offset.cast("int").alias("off"), ((text["off"] != "") | (text["abb"] != "")).alias("zoned"), epoch.alias("ep"),
    )


def with_normal_form(df: DataFrame, value: str, zone: str, locale: str, *, ambiguous: str = "earlier", nonexistent: str = "shift", out: str = "normal_form") -> DataFrame:
    """Add out (YYYY, YYYY-MM, YYYY-MM-DD or the UTC instant) and out_form (the form's name) for the column value.

    ambiguous: earlier or later, for wall times that occur twice. nonexistent: shift (forward by the gap) or null, for wall
    times that a zone skips. Null, blank, placeholder and impossible values give null in both columns.
    """
    if ambiguous not in ("earlier", "later") or nonexistent not in ("shift", "null"):
        raise ValueError("ambiguous is earlier or later; nonexistent is shift or null")
    v = F.regexp_replace(F.col(value), r"(?U)^\s+|\s+$", "")
    step = df.withColumn("__v", once(v))
    step = step.withColumn("__s", once(F.split(common_notation(F.col("__v")), r"\|")))
    step = step.withColumn("__p", once(F.when(F.col("__s").isNotNull(), parsed(F.col("__s"), F.col(zone), F.col(locale)))))
    p = {k: F.col(f"__p.{k}") for k in ("form", "y", "mo", "d", "h", "mi", "s", "off", "zoned", "ep")}
    day = F.try_to_date(F.format_string("%04d-%02d-%02d", p["y"], F.coalesce(p["mo"], F.lit(1)), F.coalesce(p["d"], F.lit(1))), "yyyy-MM-dd")
    good_day = day.isNotNull() & (p["y"] >= 1)
    good_time = (p["h"] < 24) & (p["mi"] < 60) & (p["s"] < 60)
    as_utc = F.try_make_timestamp(p["y"], p["mo"], p["d"], p["h"], p["mi"], p["s"], F.lit("UTC"))
    in_zone = F.try_make_timestamp(p["y"], p["mo"], p["d"], p["h"], p["mi"], p["s"], F.when(good_time, F.coalesce(F.col(zone), F.lit("UTC"))))
    wall = F.from_utc_timestamp(in_zone, F.coalesce(F.col(zone), F.lit("UTC")))
    site = in_zone
    if ambiguous == "later":
        for minutes in (30, 60):
            again = in_zone + F.expr(f"INTERVAL {minutes} MINUTES")
            site = F.when(F.from_utc_timestamp(again, F.coalesce(F.col(zone), F.lit("UTC"))) == as_utc, again).otherwise(site)
    if nonexistent == "null":
        site = F.when(wall == as_utc, site)
    offset = F.when(p["off"].isNotNull(), F.timestamp_seconds(F.unix_timestamp(as_utc) - p["off"] * 60))
    instant = F.when(p["ep"].isNotNull(), F.timestamp_seconds(p["ep"])).when(~good_day | ~good_time, None).when(p["zoned"], offset).otherwise(site)
    stamp = F.date_format(F.to_utc_timestamp(F.col("__i"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    normal = (
        F.when(p["ep"].isNotNull() | p["h"].isNotNull(), stamp)
        .when(good_day & p["d"].isNotNull(), F.date_format(day, "yyyy-MM-dd"))
        .when(good_day & p["mo"].isNotNull(), F.date_format(day, "yyyy-MM"))
        .when(good_day & p["mo"].isNull() & p["d"].isNull(), F.format_string("%04d", p["y"]))
    )
    step = step.withColumn("__i", once(instant)).withColumn(out, once(normal))
    return step.withColumn(f"{out}_form", F.when(F.col(out).isNotNull(), p["form"])).drop("__v", "__s", "__p", "__i")
