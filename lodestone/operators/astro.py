"""Chart arithmetic. Bodies are rows (chart_id, body, longitude) with sidereal longitudes; 'Lagna' is the rising point."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import many

# Names, rulers, exaltations, friendships and periods of the tradition.
SIGNS = ["Aries", "Taurus", "Gemini", "Cancer", "Leo", "Virgo", "Libra", "Scorpio", "Sagittarius", "Capricorn", "Aquarius", "Pisces"]
PLANETS = ["Sun", "Moon", "Mars", "Mercury", "Jupiter", "Venus", "Saturn"]
RULERS = ["Mars", "Venus", "Mercury", "Moon", "Sun", "Mercury", "Venus", "Mars", "Jupiter", "Saturn", "Saturn", "Jupiter"]
EXALTED = {"Sun": "Aries", "Moon": "Taurus", "Mars": "Capricorn", "Mercury": "Virgo", "Jupiter": "Cancer", "Venus": "Pisces", "Saturn": "Libra"}
COMBUST_AT = {"Moon": (12, 12), "Mars": (17, 17), "Mercury": (14, 12), "Jupiter": (11, 11), "Venus": (10, 8), "Saturn": (15, 15)}
FRIENDS = {"Sun": ["Moon", "Mars", "Jupiter"], "Moon": ["Sun", "Mercury"], "Mars": ["Sun", "Moon", "Jupiter"], "Mercury": ["Sun", "Venus"], "Jupiter": ["Sun", "Moon", "Mars"], "Venus": ["Mercury", "Saturn"], "Saturn": ["Mercury", "Venus"]}
ENEMIES = {"Sun": ["Venus", "Saturn"], "Moon": [], "Mars": ["Mercury"], "Mercury": ["Moon"], "Jupiter": ["Mercury", "Venus"], "Venus": ["Sun", "Moon"], "Saturn": ["Sun", "Moon", "Mars"]}
NAKSHATRAS = [
    "Ashwini", "Bharani", "Krittika", "Rohini", "Mrigashira", "Ardra", "Punarvasu", "Pushya", "Ashlesha", "Magha", "Purva Phalguni", "Uttara Phalguni", "Hasta", "Chitra",
    "Swati", "Vishakha", "Anuradha", "Jyeshtha", "Mula", "Purva Ashadha", "Uttara Ashadha", "Shravana", "Dhanishta", "Shatabhisha", "Purva Bhadrapada", "Uttara Bhadrapada", "Revati",
]
PERIODS = [("Ketu", 7), ("Venus", 20), ("Sun", 6), ("Moon", 10), ("Mars", 7), ("Rahu", 18), ("Jupiter", 16), ("Saturn", 19), ("Mercury", 17)]
ASPECTS = {"Mars": [4, 7, 8], "Jupiter": [5, 7, 9], "Saturn": [3, 7, 10]}
MAHAPURUSHA = {"Mars": "Ruchaka", "Mercury": "Bhadra", "Jupiter": "Hamsa", "Venus": "Malavya", "Saturn": "Sasa"}
YEAR = 365.25


def _pick(names: list, i: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in names]), i.cast("int"))  # null for null, where element_at fails


def _by(key: Column, table: dict, default=None) -> Column:
    out = F.when(key == next(iter(table)), F.lit(next(iter(table.values()))))
    for k, v in list(table.items())[1:]:
        out = out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def sign_no(longitude: Column) -> Column:
    return F.pmod(F.floor(longitude / 30), F.lit(12)).cast("int")


def count_from(a: Column, b: Column) -> Column:
    """Inclusive count of signs from a to b: a sign is the first from itself."""
    return (F.pmod(b - a, F.lit(12)) + 1).cast("int")


def is_kendra(house: Column) -> Column:
    return house.isin(1, 4, 7, 10)


# The coefficients of the two polynomials below (IAU 1976 precession; mean lunar node).
def ayanamsa(jd: Column) -> Column:
    """Mean Lahiri value in degrees: a fixed value at 1956-03-21 and IAU 1976 precession since."""
    t = (jd - 2451545.0) / 36525
    t0 = (2435553.5 - 2451545.0) / 36525
    arc = lambda x: 5029.0966 * x + 1.11113 * x * x - 0.000006 * x * x * x
    return F.lit(23.250182778 - 0.004658035) + (arc(t) - arc(t0)) / 3600


def mean_node(jd: Column) -> Column:
    t = (jd - 2451545.0) / 36525
    return F.pmod(125.0445479 - 1934.1362891 * t + 0.0020754 * t * t + t * t * t / 467441 - t * t * t * t / 60616000, F.lit(360.0))


def ascendant(sidereal_hours: Column, longitude: Column, latitude: Column, obliquity: Column) -> Column:
    """Tropical longitude of the rising point in degrees; obliquity in radians."""
    theta, phi = F.radians(F.pmod(sidereal_hours * 15 + longitude, F.lit(360.0))), F.radians(latitude)
    return F.pmod(F.degrees(F.atan2(F.cos(theta), -(F.sin(theta) * F.cos(obliquity) + F.tan(phi) * F.sin(obliquity)))), F.lit(360.0))


def navamsa_no(longitude: Column) -> Column:
    """Ninth-part sign: 108 parts of the circle, in the order of the signs."""
    part = F.floor((longitude - 30 * F.floor(longitude / 30)) / (30 / 9)).cast("int")
    s = sign_no(longitude)
    start = F.when(s % 3 == 0, s).when(s % 3 == 1, s + 8).otherwise(s + 4)
    return F.pmod(start + part, F.lit(12)).cast("int")


def _read_off(body: Column, sign: Column, rule: Callable[[str, int], object]) -> Column:
    """rule(planet, sign's number), read off a table of all its values: a short expression, which Spark compiles; null for other bodies."""
    table = F.array(*[F.lit(None if b is None else rule(b, s)) for b in (None, *PLANETS) for s in range(12)])
    return F.element_at(table, (F.array_position(F.array(*map(F.lit, PLANETS)), body) * 12 + sign + 1).cast("int"))


def _dignity_in(body: str, sign: int) -> str | None:
    up = SIGNS.index(EXALTED[body])
    return "exalted" if up == sign else "debilitated" if (up + 6) % 12 == sign else "own sign" if RULERS[sign] == body else None


def _relation_in(body: str, sign: int) -> str | None:
    lord = RULERS[sign]
    return None if lord == body else "friend's sign" if lord in FRIENDS[body] else "enemy's sign" if lord in ENEMIES[body] else "neutral sign"


def _dignity(body: Column, sign: Column) -> Column:
    return _read_off(body, sign, _dignity_in)


def _placed(of: Callable[[str], Column], lagna_no: Column, sun: Column) -> dict[str, Column]:
    """What is told of a body, whose name, longitude, motion and sign of() gives."""
    lon, sign, body, span = of("longitude"), of("sign_no"), of("body"), 360 / 27
    gap = F.abs(F.pmod(lon - sun + 180, F.lit(360.0)) - 180)
    orbs = [_read_off(body, F.lit(0), lambda b, s, i=i: COMBUST_AT.get(b, (None, None))[i]) for i in (0, 1)]
    orb = F.when(of("retrograde"), orbs[1]).otherwise(orbs[0])
    relation = _read_off(body, sign, _relation_in)
    d9 = navamsa_no(lon)
    return {
        "body": body, "longitude": lon, "retrograde": of("retrograde"), "sign_no": sign, "lagna_no": lagna_no, "sign": _pick(SIGNS, sign), "house": count_from(lagna_no, sign),
        "nakshatra": _pick(NAKSHATRAS, F.pmod(F.floor(lon / span), F.lit(27))), "pada": (F.floor((lon - span * F.floor(lon / span)) / (span / 4)) + 1).cast("int"),
        "dignity": _dignity(body, sign), "combust": F.coalesce(gap <= orb, F.lit(False)), "navamsa": _pick(SIGNS, d9),
        "d9_dignity": _dignity(body, d9), "vargottama": d9 == sign, "relation": relation,
    }


def _ruling(c: str = "bodies") -> tuple[Column, Column]:
    """The rising sign and the Sun's longitude, of a chart's list of bodies."""
    of = lambda name, value: F.array_max(F.transform(F.filter(c, lambda b: b["body"] == name), value))
    return of("Lagna", lambda b: sign_no(b["longitude"])), of("Sun", lambda b: b["longitude"])


def placements(bodies: DataFrame) -> DataFrame:
    """bodies (chart_id, body, longitude, retrograde) with sign, house, nakshatra, pada, dignity, combust, navamsa, d9_dignity and relation.

    The rising point and the Sun of a chart reach its other rows over a window on the chart. Charts that are one row each already,
    (chart_id, bodies: list of body, longitude, retrograde), become rows without a shuffle.
    """
    if "bodies" in bodies.columns:
        lagna, sun = _ruling()
        each = bodies.select("chart_id", lagna.alias("lagna_no"), sun.alias("sun"), F.explode("bodies").alias("e"))
        p = each.select("chart_id", "e.body", "e.longitude", "e.retrograde", sign_no(F.col("e.longitude")).alias("sign_no"), "lagna_no", "sun")
    else:
        chart, lon = Window.partitionBy("chart_id"), F.col("longitude")
        rising, sun = F.max(F.when(F.col("body") == "Lagna", sign_no(lon))).over(chart), F.max(F.when(F.col("body") == "Sun", lon)).over(chart)
        p = bodies.select("chart_id", "body", "longitude", "retrograde", sign_no(lon).alias("sign_no"), rising.alias("lagna_no"), sun.alias("sun"))
    return many(p.select("chart_id", *[c.alias(name) for name, c in _placed(F.col, F.col("lagna_no"), F.col("sun")).items()]))


def charted(placed: DataFrame, *fields: str) -> DataFrame:
    """(chart_id, lagna_no, placed): one row a chart, with the named fields of each of its bodies, of placements() or of charts that are one row each."""
    if "bodies" not in placed.columns:
        return placed.groupBy("chart_id").agg(F.max("lagna_no").alias("lagna_no"), F.collect_list(F.struct(*fields)).alias("placed"))
    lagna, sun = _ruling()
    signed = F.transform("bodies", lambda b: F.struct(*[b[c].alias(c) for c in ("body", "longitude", "retrograde")], sign_no(b["longitude"]).alias("sign_no")))
    charts = placed.select("chart_id", lagna.alias("lagna_no"), sun.alias("sun"), signed.alias("signed"))

    def told(b: Column) -> Column:
        known = _placed(b.__getitem__, F.col("lagna_no"), F.col("sun"))
        return F.struct(*[known[c].alias(c) for c in fields])

    return charts.select("chart_id", "lagna_no", F.transform("signed", told).alias("placed"))


def lordships(placed: DataFrame) -> DataFrame:
    """(chart_id, house, lord) of each chart's twelve houses."""
    lagna = placed.where("body = 'Lagna'").select("chart_id", "lagna_no", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("house"))
    return many(lagna.select("chart_id", "house", _pick(RULERS, F.pmod(F.col("lagna_no") + F.col("house") - 1, F.lit(12))).alias("lord")))


def aspects(placed: DataFrame) -> DataFrame:
    """(chart_id, body, house): houses that each planet looks at; the nodes look at none."""
    looks = F.explode(F.coalesce(*[F.when(F.col("body") == b, F.array(*map(F.lit, n))) for b, n in ASPECTS.items()], F.array(F.lit(7)))).alias("n")
    each = placed.where(F.col("body").isin(PLANETS)).select("chart_id", "body", "house", looks)
    return many(each.select("chart_id", "body", (F.pmod(F.col("house") + F.col("n") - 2, F.lit(12)) + 1).cast("int").alias("house")))


def periods_from(longitude: Column, birth: Column) -> Column:
    """The nine periods from birth, list of (seq, lord, start, end), of the Moon's longitude."""
    names, years, span = [p[0] for p in PERIODS], [float(p[1]) for p in PERIODS], 360 / 27
    # for each first lord, over the nine: years up to the period's end
    passed = [sum(years[(f + k) % 9] for k in range(seq + 1)) for f in range(9) for seq in range(9)]
    first, elapsed = F.pmod(F.floor(longitude / span), F.lit(9)).cast("int"), longitude / span - F.floor(longitude / span)
    day = lambda y: F.date_add(birth, F.floor(y * YEAR).cast("int"))

    def period(seq: int) -> Column:
        i, upto = F.pmod(first + seq, F.lit(9)), _pick(passed, first * 9 + seq) - elapsed * _pick(years, first)
        return F.struct(F.lit(seq).alias("seq"), _pick(names, i).alias("lord"), (day(upto - _pick(years, i)) if seq else birth).alias("start"), day(upto).alias("end"))

    return F.array(*map(period, range(9)))


def dashas(moons: DataFrame) -> DataFrame:
    """(chart_id, seq, lord, start, end): the nine periods from birth, of moons (chart_id, longitude, birth date)."""
    return many(moons.select("chart_id", F.explode(periods_from(F.col("longitude"), F.col("birth"))).alias("p")).select("chart_id", "p.*"))


def parts_of(period: Column) -> Column:
    """Nine parts, list of (sub, start, end), of a period (lord, end): measured back from its end over its full length."""
    names, years = [p[0] for p in PERIODS], [float(p[1]) for p in PERIODS]
    days: list[tuple[str, int, int]] = []  # of each lord's nine: days from the period's end to the start and the end of the part
    for i, full in enumerate(years):
        upto = 0.0
        for k in range(9):
            part = full * years[(i + k) % 9] / 120
            upto += part
            days.append((names[(i + k) % 9], *(math.floor((y - full) * YEAR + 1e-6) for y in (upto - part, upto))))
    first = (F.array_position(F.array(*map(F.lit, names)), period["lord"]).cast("int") - 1) * 9
    at = lambda n, k: _pick([d[n] for d in days], first + k)
    return F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: F.struct(at(0, k).alias("sub"), F.date_add(period["end"], at(1, k)).alias("start"), F.date_add(period["end"], at(2, k)).alias("end")))


def antardashas(periods: DataFrame) -> DataFrame:
    """(chart_id, lord, sub, start, end): nine parts of each period, measured back from its end over its full length."""
    parts = parts_of(F.struct("lord", "end"))
    return many(periods.select("chart_id", "lord", F.explode(parts).alias("p")).select("chart_id", "lord", "p.*"))


def running(periods: DataFrame, on: str) -> DataFrame:
    """Periods that hold a date."""
    return periods.where((F.col("start") <= F.lit(on).cast("date")) & (F.lit(on).cast("date") < F.col("end")))


def _wide(charts: DataFrame) -> DataFrame:
    """Charts of charted(), with b: map of body to its other fields, and lords: of the houses in their order."""
    fields = [f for f in charts.schema["placed"].dataType.elementType.names if f != "body"]
    body = F.map_from_entries(F.transform("placed", lambda p: F.struct(p["body"], F.struct(*[p[f].alias(f) for f in fields]))))
    lords = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda h: _pick(RULERS, F.pmod(F.col("lagna_no") + h, F.lit(12))))
    return charts.withColumns({"b": body, "lords": lords})


def debility_cancelled(placed: DataFrame) -> DataFrame:
    """(chart_id, body, classical, later): debilitated planets, whether a kendra rule, or a conjunction or ninth-part rule, cancels it."""
    exalted_in = {s: b for b, s in EXALTED.items()}
    fallen = placed.where("dignity = 'debilitated'").select("chart_id", "body", "sign_no", "house", "navamsa")
    lords = [("dispositor", _pick(RULERS, F.col("sign_no"))), ("exaltation lord", _by(F.col("body"), {b: RULERS[SIGNS.index(s)] for b, s in EXALTED.items()})), ("exalted here", _by(_pick(SIGNS, F.col("sign_no")), exalted_in))]
    helpers = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), w.alias("who")) for r, w in lords]))
    h = many(fallen.select("*", helpers.alias("x")).select("*", "x.role", "x.who").drop("x").where(F.col("who").isNotNull() & ((F.col("who") != F.col("body")) | (F.col("role") == "exaltation lord"))))
    moon = placed.where("body = 'Moon'").select("chart_id", F.col("sign_no").alias("moon"))
    at = placed.select("chart_id", F.col("body").alias("who"), F.col("sign_no").alias("w_sign"), F.col("house").alias("w_house"))
    j = h.join(at, ["chart_id", "who"]).join(moon, "chart_id")
    kendra = is_kendra(F.col("w_house")) | ((F.col("who") != "Moon") & is_kendra(count_from(F.col("moon"), F.col("w_sign"))))
    joined = (F.col("role") != "exaltation lord") & (F.col("who") != F.col("body")) & (F.col("w_sign") == F.col("sign_no"))
    g = j.groupBy("chart_id", "body").agg(F.bool_or(kendra).alias("classical"), F.bool_or(joined).alias("joined"))
    ninth = F.col("navamsa") == _by(F.col("body"), EXALTED)
    return fallen.join(g, ["chart_id", "body"], "left").select("chart_id", "body", F.coalesce("classical", F.lit(False)).alias("classical"), (F.coalesce("joined", F.lit(False)) | ninth).alias("later"))


def yogas(placed: DataFrame) -> DataFrame:
    """(chart_id, name, bodies): combinations found. Each rule is an expression over one chart's row, so the whole is one grouping."""
    lord = lambda h: F.element_at("lords", F.lit(h))
    at, seat = (lambda b: F.col(f"at_{b}")), (lambda h: F.col(f"seat_{h}"))
    # looked up once each: a body, and the body that rules a house
    wide = _wide(charted(placed, "body", "sign_no", "house", "dignity"))
    w = wide.withColumns({**{f"at_{b}": F.element_at("b", F.lit(b)) for b in PLANETS}, **{f"seat_{h}": F.element_at("b", lord(h)) for h in range(1, 13)}})
    rules = [F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(name).alias("name"), bodies.alias("bodies"))) for name, holds, bodies in yoga_rules(at, lord, seat, at("Moon").isNotNull())]
    return w.select("chart_id", F.explode(F.array_distinct(F.array_compact(F.array(*rules)))).alias("y")).select("chart_id", "y.name", "y.bodies")


def yoga_rules(at: Callable[[str], Column], lord: Callable[[int], Column], seat: Callable[[int], Column], moon_placed: Column) -> list[tuple[str, Column, Column]]:
    """(name, whether it holds, bodies) of every combination in a chart of which at(body) gives sign_no, house and dignity, lord(house) the body that rules, and seat(house) where that is."""
    moon = at("Moon")["sign_no"]
    rules: list[tuple[str, Column, Column]] = []

    def rule(name: str, holds: Column, bodies: Column) -> None:
        rules.append((name, holds, bodies))

    rule("Gajakesari", is_kendra(count_from(moon, at("Jupiter")["sign_no"])), F.lit("Jupiter"))
    rule("Budha-Aditya", at("Sun")["sign_no"] == at("Mercury")["sign_no"], F.lit("Sun, Mercury"))
    rule("Chandra-Mangala", moon == at("Mars")["sign_no"], F.lit("Moon, Mars"))
    for b, name in MAHAPURUSHA.items():
        rule(name, at(b)["dignity"].isin("exalted", "own sign") & is_kendra(at(b)["house"]), F.lit(b))
    beside = reduce(lambda x, y: x | y, [count_from(moon, at(b)["sign_no"]).isin(2, 12) for b in PLANETS if b not in ("Sun", "Moon")])
    help_ = F.array_compact(F.array(*[F.when(is_kendra(at(b)["house"]) | is_kendra(count_from(moon, at(b)["sign_no"])), F.lit(b)) for b in PLANETS if b != "Moon"]))
    rule("Kemadruma", ~beside & (F.size(help_) == 0), F.lit(""))
    rule("Kemadruma (cancelled)", ~beside & (F.size(help_) > 0), F.array_join(help_, ", "))
    for b in PLANETS:
        rules_some = lambda hs, b=b: reduce(lambda x, y: x | y, [lord(h) == b for h in hs])
        rule("Raja yoga", rules_some((4, 7, 10)) & rules_some((5, 9)), F.lit(b))
    for name, ours, theirs in (("Raja yoga", (1, 4, 7, 10), (1, 5, 9)), ("Dhana yoga", (2, 11), (1, 5, 9))):
        for h, g in product(ours, theirs):
            a, b = lord(h), lord(g)
            rule(name, (a != b) & (seat(h)["sign_no"] == seat(g)["sign_no"]), F.concat(F.least(a, b), F.lit(", "), F.greatest(a, b)))
    for h, name in ((6, "Harsha"), (8, "Sarala"), (12, "Vimala")):
        rule(name, seat(h)["house"].isin(6, 8, 12), lord(h))
    exalted_in = {s: b for b, s in EXALTED.items()}
    for b, up in EXALTED.items():  # as debility_cancelled() has it: a fallen planet's sign, and so who may help it, is fixed
        fallen = (SIGNS.index(up) + 6) % 12
        helpers = {RULERS[SIGNS.index(up)], *({RULERS[fallen], exalted_in.get(SIGNS[fallen])} - {b, None})}
        helped = [is_kendra(at(x)["house"]) | (is_kendra(count_from(moon, at(x)["sign_no"])) if x != "Moon" else F.lit(False)) for x in sorted(helpers)]
        rule("Neecha Bhanga", (at(b)["dignity"] == "debilitated") & moon_placed & reduce(lambda x, y: x | y, [F.coalesce(x, F.lit(False)) for x in helped]), F.lit(b))
    return rules


def position_claims(text: Column) -> Column:
    """(body, kind, value) of statements 'Body is/sits in [the] Sign' and 'Body ... in the Nth house' in a text."""
    names = "|".join([*PLANETS, "Rahu", "Ketu"])
    signs = "|".join(SIGNS)
    found = F.regexp_extract_all(text, F.lit(rf"\b((?:{names})\s+(?:is|sits|stands|placed|falls|lies)?\s*(?:placed\s+)?in\s+(?:the\s+)?(?:{signs}|\d{{1,2}}(?:st|nd|rd|th)\s+house))"), F.lit(1))
    body = lambda m: F.regexp_extract(m, rf"^({names})", 1)
    house = lambda m: F.regexp_extract(m, r"(\d{1,2})(?:st|nd|rd|th)\s+house$", 1)
    return F.transform(found, lambda m: F.when(house(m) != "", F.struct(body(m).alias("body"), F.lit("house").alias("kind"), house(m).alias("value"))).otherwise(F.struct(body(m).alias("body"), F.lit("sign").alias("kind"), F.regexp_extract(m, rf"({signs})$", 1).alias("value"))))


def claim_mismatches(texts: DataFrame, placed: DataFrame) -> DataFrame:
    """(text_id, body, kind, value, actual) of claims in texts (text_id, chart_id, text) that the chart does not bear out."""
    c = many(texts.select("text_id", "chart_id", F.explode(position_claims(F.col("text"))).alias("c")).select("text_id", "chart_id", "c.*"))
    j = c.join(placed.select("chart_id", "body", "sign", F.col("house").cast("string").alias("house")), ["chart_id", "body"])
    actual = F.when(F.col("kind") == "house", F.col("house")).otherwise(F.col("sign"))
    return j.withColumn("actual", actual).where("actual <> value").select("text_id", "body", "kind", "value", "actual")


def without_flagged(texts: DataFrame, flagged: DataFrame) -> DataFrame:
    """texts (text_id, text) without the sentences that hold a flagged phrase (text_id, phrase), unless they quote."""
    s = many(texts.select("text_id", F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("n", "s")))
    bad = s.join(flagged, "text_id").where(F.contains("s", "phrase") & ~F.col("s").rlike("[\"“”]")).select("text_id", "n").distinct()
    kept = s.join(bad, ["text_id", "n"], "left_anti")
    g = kept.groupBy("text_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "s"))), lambda e: e["s"]), " ").alias("text"))
    return texts.select("text_id").join(g, "text_id", "left").select("text_id", F.coalesce("text", F.lit("")).alias("text"))


#: Kinds of statements: pattern, and the patterns that read body and value from what it finds. Body and value are compared as text.
_BODY, _NTH, _SIGN = "|".join([*PLANETS, "Rahu", "Ketu"]), r"\d{1,2}(?:st|nd|rd|th)", "|".join(SIGNS)
STATED_YOGAS = ["Gajakesari", "Budha-Aditya", "Chandra-Mangala", "Ruchaka", "Bhadra", "Hamsa", "Malavya", "Sasa", "Harsha", "Sarala", "Vimala", "Kemadruma"]
#: Where a body may stand: its first letter is looked at before anything else, at every place of a text.
_AT = r"(?=[JKMRSV])\b"
CLAIMS = [
    ("dignity", rf"{_AT}(?:{_BODY})\s+(?:is\s+)?(?:exalted|debilitated)\b", rf"^({_BODY})", r"(exalted|debilitated)$"),
    ("own sign", rf"{_AT}(?:{_BODY})\s+is\s+in\s+its\s+own\s+sign\b", rf"^({_BODY})", r"(own sign)$"),
    ("lord", rf"{_AT}(?:{_BODY}),?\s+(?:is\s+)?(?:the\s+)?(?:lord|ruler)\s+of\s+the\s+{_NTH}", rf"^({_BODY})", r"(\d{1,2})(?:st|nd|rd|th)$"),
    ("lord", rf"{_AT}(?:{_BODY})\s+rules\s+the\s+{_NTH}", rf"^({_BODY})", r"(\d{1,2})(?:st|nd|rd|th)$"),
    ("lord in", rf"(?=[l\d])\b(?:lord\s+of\s+the\s+{_NTH}|{_NTH}\s+lord)(?:\s+is|\s+sits)?\s+in\s+the\s+{_NTH}", r"^\D*(\d{1,2})", r"(\d{1,2})(?:st|nd|rd|th)$"),
    ("aspect", rf"{_AT}(?:{_BODY})\s+aspects\s+the\s+{_NTH}", rf"^({_BODY})", r"(\d{1,2})(?:st|nd|rd|th)$"),
    ("aspect", rf"(?=\d)\b{_NTH}\s+house\s+is\s+aspected\s+by\s+(?:{_BODY})", rf"({_BODY})$", r"^(\d{1,2})"),
    ("combust", rf"{_AT}(?:{_BODY})\s+is\s+combust\b", rf"^({_BODY})", r"(combust)$"),
    ("retrograde", rf"{_AT}(?:{_BODY})\s+is\s+retrograde\b", rf"^({_BODY})", r"(retrograde)$"),
    ("vargottama", rf"{_AT}(?:{_BODY})\s+is\s+Vargottama\b", rf"^({_BODY})", r"(Vargottama)$"),
    ("navamsa", rf"{_AT}(?:{_BODY})\s+is\s+in\s+(?:{_SIGN})\s+in\s+the\s+Navamsa\b", rf"^({_BODY})", rf"({_SIGN})\s+in\s+the\s+Navamsa$"),
    ("lagna", rf"(?=[Lar])\b(?:Lagna|ascendant|rising\s+sign)\s+is\s+(?:in\s+)?(?:{_SIGN})\b", r"^()", rf"({_SIGN})$"),
    ("from moon", rf"{_AT}(?:{_BODY})\s+is\s+(?:in\s+)?the\s+{_NTH}\s+from\s+the\s+Moon\b", rf"^({_BODY})", r"(\d{1,2})(?:st|nd|rd|th)\s+from"),
    ("conjunct", rf"{_AT}(?:{_BODY})\s+is\s+conjunct\s+(?:{_BODY})\b", rf"^({_BODY})", rf"({_BODY})$"),
    ("cancelled", rf"{_AT}(?:{_BODY})(?:'s)?\s+debility\s+is\s+cancelled\b", rf"^({_BODY})", r"(cancelled)$"),
    ("yoga", rf"(?=[A-Z])\b(?:{'|'.join(STATED_YOGAS)})\s+yoga\b", r"^()", r"^([\w-]+)"),
    ("dasha end", rf"{_AT}(?:{_BODY})\s+mahadasha\s+(?:runs|lasts)\s+until\s+\d{{4}}\b", rf"^({_BODY})", r"(\d{4})$"),
]


#: Of each kind, words of which a statement holds one.
NEEDED = {
    "dignity": ["exalted", "debilitated"], "own sign": ["own"], "lord": ["lord", "ruler", "rules"], "lord in": ["lord"], "aspect": ["aspect"], "combust": ["combust"], "retrograde": ["retrograde"], "vargottama": ["Vargottama"],
    "navamsa": ["Navamsa"], "lagna": ["Lagna", "ascendant", "rising"], "from moon": ["from"], "conjunct": ["conjunct"], "cancelled": ["debility"], "yoga": ["yoga"], "dasha end": ["mahadasha"],
}


def fact_claims(text: Column) -> Column:
    """(kind, body, value) of statements in a text, of the kinds in CLAIMS."""

    none = F.array().cast("array<struct<kind:string,body:string,value:string>>")

    def found(kind: str, pattern: str, body: str, value: str) -> Column:
        hits = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
        read = F.transform(hits, lambda m: F.struct(F.lit(kind).alias("kind"), F.regexp_extract(m, body, 1).alias("body"), F.regexp_extract(m, value, 1).alias("value")))
        # a pattern is run only over texts that hold one of the words it needs
        return F.when(reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in NEEDED[kind]]), read).otherwise(none)

    return F.concat(*[found(*k) for k in CLAIMS])


def period_lists(periods: DataFrame) -> DataFrame:
    """(chart_id, periods: list of lord, start, end): one row a chart, of periods() or of charts that are one row each already."""
    return periods if "periods" in periods.columns else periods.groupBy("chart_id").agg(F.collect_list(F.struct("lord", "start", "end")).alias("periods"))


def _held(c: Column) -> Column:
    """Whether a chart that is one row, of _wide() with periods, holds a statement c (kind, body, value) of the kinds in CLAIMS.

    Only what a statement speaks of is worked out: its body, its house or its yoga.
    """
    body, value, lagna = c["body"], c["value"], F.col("lagna_no")
    within = lambda name: F.element_at("b", name)

    def told(name: Column) -> dict[str, Column]:
        sign = within(name)["sign_no"]
        return {"sign_no": sign, "house": count_from(lagna, sign)}

    planets = {b: {**told(F.lit(b)), "dignity": _dignity(F.lit(b), within(F.lit(b))["sign_no"])} for b in PLANETS}
    lords = [told(F.get("lords", F.lit(h))) for h in range(12)]
    yoga = yoga_rules(planets.__getitem__, lambda h: F.get("lords", F.lit(h - 1)), lambda h: lords[h - 1], within(F.lit("Moon")).isNotNull())
    x, is_ = _placed(lambda f: body if f == "body" else within(body)[f], lagna, within(F.lit("Sun"))["longitude"]), lambda n: n.cast("string") == value
    house = lambda holds: F.exists(F.sequence(F.lit(1), F.lit(12)), lambda h: holds(h, F.get("lords", h - 1)))
    looks = F.coalesce(*[F.when(body == b, F.array(*map(F.lit, n))) for b, n in ASPECTS.items()], F.when(body.isin(PLANETS), F.array(F.lit(7))))
    named = lambda of, is_it: reduce(lambda out, y: out.when(of == y[0], y[1]), is_it, F)
    rules = {
        "dignity": x["dignity"] == value, "own sign": x["dignity"] == value, "combust": x["combust"], "retrograde": x["retrograde"], "vargottama": x["vargottama"], "navamsa": x["navamsa"] == value,
        "lagna": within(F.lit("Lagna")).isNotNull() & (_pick(SIGNS, lagna) == value), "from moon": is_(count_from(planets["Moon"]["sign_no"], x["sign_no"])),
        # only a lord that is placed is known to rule
        "lord": house(lambda h, ruler: is_(h) & (ruler == body)) & within(body).isNotNull(), "lord in": house(lambda h, ruler: (h.cast("string") == body) & is_(told(ruler)["house"])),
        "aspect": F.exists(looks, lambda n: is_(F.pmod(x["house"] + n - 2, F.lit(12)) + 1)), "conjunct": (body != value) & (x["sign_no"] == told(value)["sign_no"]),
        "cancelled": named(body, [(b, holds) for b, (_, holds, _) in zip(EXALTED, [y for y in yoga if y[0] == "Neecha Bhanga"])]),
        "yoga": named(value, [(name, holds) for name, holds, _ in yoga if name in STATED_YOGAS]),
        "dasha end": F.exists("periods", lambda p: (p["lord"] == body) & is_(F.year(p["end"]))),
    }
    return F.coalesce(named(c["kind"], list(rules.items())), F.lit(False))


def unfounded_claims(texts: DataFrame, placed: DataFrame, periods: DataFrame | None = None) -> DataFrame:
    """(text_id, kind, body, value) stated in texts (text_id, chart_id, text) that the chart does not hold; dates only where periods are given.

    placed: placements(), or charts that are one row each; a chart is one row, and each text's statements are looked up in it, so neither they
    nor what charts hold become rows that are dealt.
    """
    said = texts.select("text_id", "chart_id", fact_claims(F.col("text")).alias("said"))
    said = said if periods is not None else said.withColumn("said", F.filter("said", lambda c: c["kind"] != "dasha end"))
    charts = charted(placed, "body", "longitude", "retrograde", "sign_no")
    both = many(said).join(many(charts), "chart_id", "left")
    both = both.withColumn("periods", F.array().cast("array<struct<lord:string,end:date>>")) if periods is None else many(both).join(many(period_lists(periods)), "chart_id", "left")
    return _wide(both).select("text_id", F.explode(F.filter("said", lambda c: ~_held(c))).alias("c")).select("text_id", "c.kind", "c.body", "c.value")
