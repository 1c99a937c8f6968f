"""One unambiguous form for timestamps typed in many formats and zones (problem 6).

Every format is a branch of ONE regular expression with named groups. A single
``regexp_replace`` whose replacement names all groups extracts the components once; calendar
ranges are validated on the integers, and instants are put together by integer day arithmetic.
Everything runs in the JVM inside whole-stage code generation: no Python worker, and the only
shuffles are the ones the caller's joins need.

Defined results
---------------
* null, empty, blank, placeholder, unreadable and non-existing dates: ``utc`` is null;
* a value without time of day: ``YYYY-MM-DD`` as written, whatever zone comes with it;
* a value with time of day: ``YYYY-MM-DDTHH:MM:SSZ``, fractions dropped (towards the past);
* zone: the value's own, else the hint's, else the default's, else UTC;
* a wall time that occurs twice is the first of the two, a skipped one moves forward by the gap.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Month names and their usual short forms in six languages.
MONTHS = {
    1: "january jan janeiro enero ene janvier janv januar jän jänner",
    2: "february feb fevereiro fev febrero février fevrier févr fév februar",
    3: "march mar março marco marzo mars märz maerz mrz mär",
    4: "april apr abril abr avril avr",
    5: "may maio mai mayo",
    6: "june jun junho junio juin juni",
    7: "july jul julho julio juillet juil juli",
    8: "august aug agosto ago août aout",
    9: "september sep sept setembro set septiembre setiembre septembre",
    10: "october oct outubro out octubre octobre oktober okt",
    11: "november nov novembro noviembre novembre",
    12: "december dec dezembro dez diciembre dic décembre decembre déc dezember",
}

# Zone abbreviations and their offsets in minutes.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60,
    "cet": 60, "mez": 60, "cest": 120, "mesz": 120, "eet": 120, "eest": 180, "msk": 180,
    "brt": -180, "brst": -120, "art": -180, "uyt": -180, "uyst": -120, "clt": -240, "clst": -180,
    "amt": -240, "ast": -240, "adt": -180, "est": -300, "edt": -240, "cst": -360, "cdt": -300,
    "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "jst": 540, "kst": 540,
    "awst": 480, "acst": 570, "acdt": 630, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780,
}

# Places after which people name a zone, where the zone's own name differs.
ZONE_NAMES = {
    "brasilia": "America/Sao_Paulo", "brasil": "America/Sao_Paulo", "rio de janeiro": "America/Sao_Paulo",
    "lisboa": "Europe/Lisbon", "lissabon": "Europe/Lisbon", "lisbonne": "Europe/Lisbon", "roma": "Europe/Rome",
    "rom": "Europe/Rome", "italia": "Europe/Rome", "italy": "Europe/Rome", "france": "Europe/Paris",
    "berlim": "Europe/Berlin", "deutschland": "Europe/Berlin", "germany": "Europe/Berlin", "madri": "Europe/Madrid",
    "espana": "Europe/Madrid", "spain": "Europe/Madrid", "nova york": "America/New_York", "nova iorque": "America/New_York",
    "nueva york": "America/New_York", "toquio": "Asia/Tokyo", "tokio": "Asia/Tokyo", "japao": "Asia/Tokyo",
    "japon": "Asia/Tokyo", "東京": "Asia/Tokyo", "日本": "Asia/Tokyo", "日本時間": "Asia/Tokyo", "argentina": "America/Argentina/Buenos_Aires",
    "uruguay": "America/Montevideo", "montevideu": "America/Montevideo", "sidney": "Australia/Sydney", "eastern": "America/New_York",
}

#: First Gregorian year less one of the Japanese eras.
ERAS = {"令和": 2018, "平成": 1988, "昭和": 1925}

_ZONE = r"z|(?:utc|gmt)?[+\-]\d{1,2}(?::?\d{2})?|[a-z]{2,5}"
_MONTH = "|".join(sorted((m for v in MONTHS.values() for m in v.split()), key=lambda m: (-len(m), m)))
_WEEKDAY = r"(?:\p{L}{2,12}\.?(?:-feira)?,? )?"
_CLOCK = r"(?<h{k}>\d{{1,2}}):(?<n{k}>\d{{2}})(?::(?<s{k}>\d{{2}})(?:[.,]\d+)?)?(?: ?(?<a{k}>am|pm|a\.m\.|p\.m\.))?(?: ?(?<z{k}>{zone}))?"
_WORDED = r"(?<h{k}>\d{{1,2}})(?:[:h.](?<n{k}>\d{{2}})|h)(?::(?<s{k}>\d{{2}}))?(?: ?(?<a{k}>am|pm|a\.m\.|p\.m\.))?(?: ?uhr| ?h)?(?: \(?(?<z{k}>{zone})\)?)?"


def _clock(template: str, k: str) -> str:
    return template.format(k=k, zone=_ZONE)


#: Branch letter -> regular expression (on lower-case text with plain digits and spaces).
BRANCHES = {
    "a": r"(?<ya>\d{4})[-/.](?<ma>\d{1,2})[-/.](?<da>\d{1,2})(?:(?:t| ?, ?| )" + _clock(_CLOCK, "a") + r"(?:\[(?<ba>[^\]]+)\])?)?",
    "b": r"(?<yb>\d{4})(?<mb>\d{2})(?<db>\d{2})(?:t?(?<hb>\d{2})(?<nb>\d{2})(?<sb>\d{2})?(?:[.,]\d+)?(?<zb>" + _ZONE + r")?)?",
    "c": r"(?<ec>-?\d{9,10})(?:(?<fc>\d{3})(?:\d{3})?)?(?:\.\d+)?",
    "d": r"(?<pd>\d{1,2})[-/.](?<qd>\d{1,2})[-/.](?<yd>\d{4}|\d{2})(?:,? (?:às |as |à |at |a las |um )?" + _clock(_WORDED, "d") + r")?",
    "e": _WEEKDAY + r"(?<de>\d{1,2})(?:\.|er|º|°|st|nd|rd|th)?[ -](?:de )?(?<ne0>" + _MONTH + r")\.?,?[ -](?:de |del )?(?<ye>\d{4})(?:,? (?:às |as |a las |a la |à |at |um )?" + _clock(_WORDED, "e") + r")?",
    "f": _WEEKDAY + r"(?<nf0>" + _MONTH + r")\.? (?<df>\d{1,2})(?:st|nd|rd|th)?,? (?<yf>\d{4})(?:,? (?:at )?" + _clock(_WORDED, "f") + r")?",
    "g": r"(?:(?<eg>令和|平成|昭和)(?<xg>元|\d{1,2})|(?<yg>\d{4}))年 ?(?<mg>\d{1,2})月 ?(?<dg>\d{1,2})日(?: ?\(\p{L}\))?(?: ?(?<ag>午前|午後)?(?<hg>\d{1,2})(?:時|:)(?:(?<ng>\d{1,2})分?)?(?:(?<sg>\d{1,2})秒)?)?",
}

#: Output field -> groups that hold it (at most one of them is set).
FIELDS = {
    "y": "ya yb yd ye yf yg", "m": "ma mb mg", "mon": "ne0 nf0", "d": "da db de df dg", "p": "pd", "q": "qd",
    "h": "ha hb hd he hf hg", "n": "na nb nd ne nf ng", "s": "sa sb sd se sf sg", "ap": "aa ad ae af ag",
    "z": "za zb zd ze zf", "b": "ba", "e": "ec", "f": "fc", "era": "eg", "ey": "xg",
}

PATTERN = r"(?s)\A(?:" + "|".join(f"(?:{p})" for p in BRANCHES.values()) + r")\z"
REPLACEMENT = "\x01" + "\x02".join("".join(f"${{{g}}}" for g in groups.split()) for groups in FIELDS.values())

_WIDE = "０１２３４５６７８９：／－．，（）［］＋　"
_PLAIN = "0123456789:/-.,()[]+ "
_SPACES = "(?U)[\\s\\u200b-\\u200f\\u2060\\ufeff]+"


def _literal_map(d: dict) -> Column:
    """A constant string map: one foldable expression, however many entries."""
    return F.str_to_map(F.lit(";".join(f"{k}={v}" for k, v in d.items())), F.lit(";"), F.lit("="))


def zone_ids(spark: SparkSession) -> dict[str, str]:
    """Lower-case name (blanks for underscores) -> zone id, of all zones the JVM knows, and of their city parts."""
    names = sorted(spark._jvm.java.lang.String.join(",", spark._jvm.java.time.ZoneId.getAvailableZoneIds()).split(","))
    regions = ("America/", "Europe/", "Asia/", "Australia/", "Africa/", "Pacific/", "Atlantic/", "Indian/")
    cities = {n.rpartition("/")[2].lower().replace("_", " "): n for n in names if n.startswith(regions)}
    return cities | {n.lower().replace("_", " "): n for n in names if "/" in n or n in ("Japan", "Portugal")} | ZONE_NAMES


def plain(value: Column) -> Column:
    """Lower case, plain digits and signs, single blanks."""
    return F.lower(F.trim(F.regexp_replace(F.translate(value, _WIDE, _PLAIN), _SPACES, " ")))


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, by integers only."""
    yy = F.when(m <= 2, y - 1).otherwise(y)
    era = F.floor(yy / 400)
    yoe = yy - era * 400
    doy = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    doe = yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy
    return (era * 146097 + doe - 719468).cast("bigint")


def _number(c: str) -> str:
    return f"try_cast(nullif({c}, '') as int)"


def normalise(df: DataFrame, value: str, *, hint: str | None = None, default: str | None = None, month_first: str | None = None, out: str = "utc") -> DataFrame:
    """*df* with column *out*: the value's unambiguous form, or null.

    value: string column of typed times. hint: zone as people typed it. default: zone id of the
    row's origin. month_first: boolean column for all-digit dates that do not begin with the
    year. Helper columns carry a prefix of their own, so clashing names in *df* are left alone.

    Each step generates its columns from an array of one struct. The optimizer neither merges such
    steps nor pushes a later filter through them by substitution, so the pattern runs once a value
    and no expression grows with the number of steps.
    """
    ids = zone_ids(df.sparkSession)
    named, offsets, months, eras = (_literal_map(d) for d in (ids, ABBREVIATIONS, {n: m for m, ns in MONTHS.items() for n in ns.split()}, ERAS))

    def step(df: DataFrame, **columns: Column | str) -> DataFrame:
        made = [(F.expr(v) if isinstance(v, str) else v).alias(f"__tn_{k}") for k, v in columns.items()]
        return df.select("*", F.inline(F.array(F.struct(*made))))

    def offset(c: str) -> Column:
        """Seconds east of UTC of '+09:00', 'utc-3', 'brt'...; null if it is no fixed offset."""
        numeric = F.expr(f"if(size({c}p) = 3 and {_number(f'{c}p[1]')} <= 18, if({c}p[0] = '-', -60, 60) * ({_number(f'{c}p[1]')} * 60 + coalesce({_number(f'{c}p[2]')}, 0)), null)")
        return F.coalesce(numeric, F.try_element_at(offsets, F.col(c)).cast("int") * 60)

    def zone(c: str) -> Column:
        """Zone id that a typed name means; null if none."""
        return F.coalesce(F.try_element_at(named, F.col(c + "f")), F.try_element_at(named, F.regexp_replace(c + "f", r"\A(?:horario|hora|heure|time|zeit)(?: de | d'| of | )|(?: time| zeit|zeit)\z", "")))

    kept = df.columns
    df = step(df, hit=F.regexp_replace(plain(F.col(value)), PATTERN, REPLACEMENT), t=plain(F.col(hint)) if hint else F.lit(None).cast("string"))
    df = step(df, x=F.when(F.col("__tn_hit").startswith("\x01"), F.split(F.expr("substring(__tn_hit, 2)"), "\x02")))
    df = step(df, **{name: f"nullif(get(__tn_x, {i}), '')" for i, name in enumerate(FIELDS)})
    signs = r"\A(?:utc|gmt)? ?([+\-])(\d{1,2})(?::?(\d{2}))?\z"
    fold = lambda c: F.translate(f"__tn_{c}", "_áàâãäéèêíîóôõöúûüçñ", " aaaaaeeeiioooouuucn")
    df = step(df, tf=fold("t"), zf=fold("z"), bf=fold("b"), half="substring(translate(__tn_ap, '.', ''), 1, 2)",
              tp=F.split(F.regexp_replace("__tn_t", signs, "$1\x02$2\x02$3"), "\x02"), zp=F.split(F.regexp_replace("__tn_z", signs, "$1\x02$2\x02$3"), "\x02"),
              mn=F.try_element_at(months, F.col("__tn_mon")).cast("int"), en=F.try_element_at(eras, F.col("__tn_era")).cast("int"),
              first=F.coalesce(F.col(month_first), F.lit(False)) if month_first else F.lit(False))
    df = step(
        df,
        year=f"coalesce(__tn_en + if(__tn_ey = '元', 1, {_number('__tn_ey')}), {_number('__tn_y')} + if(length(__tn_y) = 2, 2000, 0))",
        month=f"coalesce({_number('__tn_m')}, __tn_mn, if(__tn_first, {_number('__tn_p')}, {_number('__tn_q')}))",
        dom=f"coalesce({_number('__tn_d')}, if(__tn_first, {_number('__tn_q')}, {_number('__tn_p')}))",
        hour=_number("__tn_h"), minute=f"coalesce({_number('__tn_n')}, 0)", second=f"coalesce({_number('__tn_s')}, 0)",
        unix="try_cast(__tn_e as bigint)",
        to=offset("__tn_t"), tz=zone("__tn_t"), zo=offset("__tn_z"), bz=zone("__tn_b"), zz=zone("__tn_z"),
    )
    month_length = "case when __tn_month in (4, 6, 9, 11) then 30 when __tn_month <> 2 then 31 when (__tn_year % 4 = 0 and __tn_year % 100 <> 0) or __tn_year % 400 = 0 then 29 else 28 end"
    df = step(
        df,
        real=f"__tn_year between 1 and 9999 and __tn_month between 1 and 12 and __tn_dom >= 1 and __tn_dom <= {month_length}",
        clock="__tn_hour between 0 and 23 and __tn_minute < 60 and __tn_second < 60 and (__tn_half is null or __tn_hour <= 12)",
        h24="case when __tn_half in ('pm', '午後') and __tn_hour < 12 then __tn_hour + 12 when __tn_half in ('am', '午前') and __tn_hour = 12 then 0 else __tn_hour end",
        days=days_from_civil(F.col("__tn_year"), F.col("__tn_month"), F.col("__tn_dom")),
        has="__tn_z is not null or __tn_b is not null",
    )
    # precedence: an offset in the value, a zone named in the value, the hint, the default, UTC
    fallback = F.when(F.col(default).isin(sorted(set(ids.values()))), F.col(default)).otherwise("UTC") if default else F.lit("UTC")
    df = step(df, local="if(__tn_real and __tn_clock, __tn_days * 86400 + __tn_h24 * 3600 + __tn_minute * 60 + __tn_second, null)",
              off="if(__tn_has, __tn_zo, if(__tn_tz is null, __tn_to, null))", place="coalesce(if(__tn_has, coalesce(__tn_bz, __tn_zz), null), if(__tn_has, null, __tn_tz))", fallback=fallback)
    zoned = "unix_seconds(to_utc_timestamp(timestamp_seconds(__tn_local), coalesce(__tn_place, __tn_fallback)))"
    df = step(df, at=f"coalesce(__tn_unix, if(__tn_off is not null, __tn_local - __tn_off, {zoned}))", day="if(__tn_real and __tn_hour is null, format_string('%04d-%02d-%02d', __tn_year, __tn_month, __tn_dom), null)")
    return df.select(*[F.col(f"`{c}`") for c in kept if c != out], F.expr("coalesce(__tn_day, date_format(timestamp_seconds(__tn_at), \"yyyy-MM-dd'T'HH:mm:ss'Z'\"))").alias(out))


def typed_times(items: DataFrame, events: DataFrame, news: DataFrame, sources: DataFrame) -> DataFrame:
    """field, row_key, value, hint, default, month_first of the three typed time columns.

    ``sources`` has one row for each catalogue entry (tens of rows; its size is left to the
    optimizer, which broadcasts it below the session's threshold).
    """
    src = sources.select(F.col("id").alias("sid"), F.col("tz").alias("default"), (F.col("country") == "US").alias("month_first")).dropDuplicates(["sid"])
    cols = ["field", "row_key", "value", "hint", "sid"]
    none = F.lit(None).cast("string")
    published = items.filter("published_at is not null").select(F.lit("published_at").alias("field"), F.col("id").cast("string").alias("row_key"), F.col("published_at").alias("value"), none.alias("hint"), F.col("source_id").alias("sid"))
    # rows come twice; they are made one before the join, so that no copy multiplies another
    owner = items.select(F.col("id").alias("item_id"), F.col("source_id").alias("sid")).dropDuplicates(["item_id"])
    starts = events.filter("starts_at is not null").select("item_id", "starts_at", "tz").distinct().join(owner, "item_id", "left")
    starts = starts.select(F.lit("starts_at").alias("field"), F.col("item_id").cast("string").alias("row_key"), F.col("starts_at").alias("value"), F.col("tz").alias("hint"), "sid")
    dated = news.filter("news_date is not null").select(F.lit("news_date").alias("field"), F.col("id").alias("row_key"), F.col("news_date").alias("value"), none.alias("hint"), F.col("source_id").alias("sid"))
    every = reduce(lambda a, b: a.unionByName(b), (published, starts, dated)).select(*cols)
    return every.join(src, "sid", "left")


def readable_times(items: DataFrame, events: DataFrame, news: DataFrame, sources: DataFrame) -> DataFrame:
    """field, row_key, utc of every value that can be read; copies of a row count once."""
    values = typed_times(items, events, news, sources)
    out = normalise(values, "value", hint="hint", default="default", month_first="month_first")
    return out.filter("utc is not null").select("field", "row_key", "utc").distinct()
