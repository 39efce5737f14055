"""Quantities recorded in different units: the units that fit physical identities among columns best.

Nothing is converted because a text says so. Each identity is an equation between columns, such as sheet width = pixel
width times pixels. For each combination of units a record's columns could be in, the logarithms of the two sides of each
identity are compared; the combination with the smallest sum of squared, scaled residuals wins. Texts only decide between
combinations that fit about as well. A runner-up that fits nearly as well makes the solution non-unique, which is flagged.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.functions.geo import MERCATOR_M
from gridwright.functions.keys import clean, number

#: Spellings of units in texts, as patterns, most special first.
UNIT_WORDS = {
    "cm": r"cm|centi ?met(?:er|re)s?|zentimetern?",
    "km": r"km|kilo ?met(?:er|re)s?|kilometern?",
    "ft": r"ft|feet|foot|fuß|fuss",
    "ruthe": r"(?:preuß\.? ?)?ruthen?",
    "deg": r"deg|degrees?|grad|lon/lat",
    "m": r"m|met(?:er|re)s?|metern?",
}
#: Fixed value: notes that say that clicks were taken on a magnified screen.
SCREEN_WORDS = r"bildschirmpixel|vierfach|(?:at|scale) 4x?\b"
#: Most unit codes accepted; the table of factors is small and fixed, and its rows become literals of the plan.
MOST_UNITS = 64
#: A runner-up within this much of the best penalty makes the solution non-unique.
MARGIN = 2.0


def unit_of_text(text: Column) -> Column:
    """The unit a text names as a whole word or right after a number, or null."""
    low = F.lower(text)
    out = F.lit(None).cast("string")
    for code, words in reversed(UNIT_WORDS.items()):
        out = F.when(low.rlike(rf"(?:^|[^\p{{L}}])(?:{words})(?:$|[^\p{{L}}])"), F.lit(code)).otherwise(out)
    return out


def factors_of(unit_factors: DataFrame) -> dict[str, tuple[str, float]]:
    """``{unit_code: (base_unit, factor)}``; rows with nulls or factors that aren't positive are left out."""
    rows = unit_factors.select("unit_code", "base_unit", "factor").limit(MOST_UNITS + 1).collect()
    if len(rows) > MOST_UNITS:
        raise ValueError(f"more than {MOST_UNITS} units")
    return {r[0]: (r[1], float(r[2])) for r in rows if r[0] and r[1] and r[2] and r[2] > 0}


#: Codes in the order that decides between units that fit equally well; others of the table come behind, by name.
TILE_CODES, WIDTH_CODES, PIXEL_CODES = ("m", "km", "ft", "cm", "ruthe", "deg"), ("m", "ft", "cm", "km", "ruthe"), ("px", "screen_px")


def codes_of(factors: dict[str, tuple[str, float]], base: str, order: tuple[str, ...], without: tuple[str, ...] = ()) -> list[str]:
    """All unit codes of the table with that base unit but those left out, the known ones in their order first."""
    place = {c: k for k, c in enumerate(order)}
    return sorted((c for c, (b, _) in factors.items() if b == base and c not in without), key=lambda c: (place.get(c, len(place)), c))


def best_combination(combos: list[tuple[tuple[str, ...], list[Column]]], out: str = "best") -> tuple[Column, Column]:
    """The costs of the combinations ``(units, penalties)`` as an array, and the choice made from it.

    A penalty that is null says nothing; a combination's cost is the sum of the others. The choice is
    ``struct(units, margins)``: the units of the cheapest (the first, on a tie) and, for each place, how much more the
    cheapest combination costs that has another unit there.
    """
    entries = []
    for k, (units, penalties) in enumerate(combos):
        cost = sum((F.coalesce(p, F.lit(0.0)) for p in penalties), F.lit(0.0))
        entries.append(F.struct(cost.alias("cost"), F.lit(k).alias("place")))
    names = F.array(*[F.array(*map(F.lit, units)) for units, _ in combos])
    least = F.array_min(f"{out}_costs")

    def margin(i: int) -> Column:
        others = F.filter(f"{out}_costs", lambda e: names[e["place"]][i] != names[least["place"]][i])
        return F.array_min(F.transform(others, lambda e: e["cost"])) - least["cost"]

    places = range(len(combos[0][0]))
    return F.array(*entries), F.struct(names[least["place"]].alias("units"), F.array(*map(margin, places)).alias("margins"))


def _log(value: Column) -> Column:
    """Logarithm to the base 10; null unless positive."""
    return F.log10(F.when(value > 0, value))


def _off(left: Column, right: Column, scale: float) -> Column:
    """Squared distance of two logarithms, in units of ``scale``, at most 400."""
    apart = (left - right) / scale
    return F.least(apart * apart, F.lit(400.0))


def _said(text_unit: Column, code: str, weight: float) -> Column:
    """A penalty if a text names another unit."""
    return F.when(text_unit != code, weight)


def _tile_costs(tiles: DataFrame, factors: dict[str, tuple[str, float]], id_col: str, keep: tuple[str, ...] = ()) -> tuple[DataFrame, Column]:
    """The tiles' numbers with ``best_costs``, and the choice made from them; see :func:`best_combination`."""
    codes = codes_of(factors, "m", TILE_CODES)
    n = {c: number(F.col(c)) for c in ("ul_x", "ul_y", "lr_x", "lr_y", "pixel_width", "width_px")}
    df = tiles.select(F.col(id_col).alias("record_id"), *[v.alias(k) for k, v in n.items()], F.col("crs_provenance").alias("said"), F.col("source_crs").alias("crs"), *keep)
    df = df.withColumn("extent", F.abs(F.col("lr_x") - F.col("ul_x"))).withColumn("px", F.abs("pixel_width"))
    usual = df.agg(
        F.percentile_approx(F.when(F.col("extent") > 1000, F.col("extent")), 0.5, 10000).alias("sheet"),
        F.percentile_approx(F.when(F.col("ul_y") > 100000, F.col("ul_y")), 0.5, 10000).alias("north"),
    )
    df = df.crossJoin(F.broadcast(usual))  # one row
    # what the text says of the bounds comes before a remark on pixels, if there is one
    about_pixels = F.regexp_extract(F.lower("said"), r"((?:pixel|px)[^;]*)$", 1)
    about_bounds = F.regexp_replace(F.lower("said"), r"(?:pixel|px)[^;]*$", "")
    df = df.withColumn("said_px", unit_of_text(about_pixels)).withColumn("said_ul", unit_of_text(about_bounds))
    degrees = F.upper("crs").rlike("4326|WGS")
    north_deg = F.log(F.tan(F.radians(F.least(F.greatest("ul_y", F.lit(-89.0)), F.lit(89.0))) / 2 + math.pi / 4)) * MERCATOR_M
    logs = {"l_sheet": F.col("extent"), "l_pixels": F.col("px") * F.col("width_px"), "l_north": F.abs("ul_y"), "l_north_deg": F.abs(north_deg), "l_usual": F.col("sheet"), "l_usual_north": F.col("north")}
    df = df.withColumns({k: _log(v) for k, v in logs.items()}).withColumn("in_degrees", degrees).withColumn("beyond", F.abs("ul_x") > 180)
    combos = []
    for u, v in product(codes, codes):
        sheet, pixels = F.col("l_sheet") + math.log10(factors[u][1]), F.col("l_pixels") + math.log10(factors[v][1])
        north = F.col("l_north_deg") if u == "deg" else F.col("l_north") + math.log10(factors[u][1])
        combos.append(((u, v), [
            _off(pixels, sheet, 0.01),
            _off(sheet, F.col("l_usual"), 0.05),
            F.when(F.col("l_sheet").isNull(), _off(pixels, F.col("l_usual"), 0.05)),
            _off(north, F.col("l_usual_north"), 0.10),
            *([F.when(F.col("beyond"), 400.0)] if u == "deg" else []),
            F.when(F.col("in_degrees") != F.lit(u == "deg"), 1.0),
            _said(F.col("said_ul"), u, 1.0), _said(F.col("said_px"), v, 1.0),
            F.lit((0.0 if u == "m" else 0.5) + (0.0 if v == "m" else 0.5)),
        ]))
    costs, best = best_combination(combos)
    return df.withColumn("best_costs", costs), best


def tile_metres(tiles: DataFrame, factors: dict[str, tuple[str, float]], keep: tuple[str, ...] = (), id_col: str = "record_id") -> DataFrame:
    """``(record_id, *keep, ul_x, pixel_width, ul_x_m, pixel_width_m)``, a row for each of ``tiles``: the lengths as they are and
    in base units, by the units of :func:`tile_units`."""
    df, best = _tile_costs(tiles, factors, id_col, keep)
    # the lambda keeps the costs out of whole-stage code, which would grow beyond 64 KB
    df = df.withColumn("units", F.transform(F.array(best["units"]), lambda units: units)[0])
    return df.select("record_id", *keep, "ul_x", "pixel_width", *[(F.col(c) * _factor(factors, F.col("units")[k])).alias(f"{c}_m") for k, c in enumerate(("ul_x", "pixel_width"))])


def tile_units(tiles: DataFrame, factors: dict[str, tuple[str, float]], id_col: str = "record_id") -> DataFrame:
    """``(record_id, field_name, raw, unit_code, base_value, unique)`` for ul_x and pixel_width, where present.

    Identities: sheet width (lr_x - ul_x) = pixel_width * width_px; sheet width = the usual sheet width (the median over
    all records, which is robust as long as most are in one unit); ul_y = the usual northing. Degrees count by the sphere:
    x as it is, y by the Mercator formula. The provenance text decides ties. Null and NaN are not present; a zero or
    negative pixel width is judged by its size; a value about which nothing is known counts as base units, not unique.
    Repeated ids are judged row by row and come out once each distinct result. An empty table gives an empty one.
    """
    df, best = _tile_costs(tiles, factors, id_col)
    df = df.withColumn("best", best)
    rows = df.select("record_id", F.explode(F.array(
        F.struct(F.lit("ul_x").alias("field_name"), F.col("ul_x").alias("raw"), F.col("best.units")[0].alias("unit_code"), ((F.col("extent").isNotNull() | F.col("ul_y").isNotNull()) & (F.col("best.margins")[0] >= MARGIN)).alias("unique")),
        F.struct(F.lit("pixel_width").alias("field_name"), F.col("pixel_width").alias("raw"), F.col("best.units")[1].alias("unit_code"), (F.col("width_px").isNotNull() & (F.col("best.margins")[1] >= MARGIN)).alias("unique")),
    )).alias("r")).select("record_id", "r.*").where("raw is not null")
    return rows.select("record_id", "field_name", "raw", "unit_code", (F.col("raw") * _factor(factors, F.col("unit_code"))).alias("base_value"), "unique").distinct()


def _factor(factors: dict[str, tuple[str, float]], code: Column) -> Column:
    out = F.lit(1.0)
    for name, (_, factor) in factors.items():
        out = F.when(code == name, F.lit(factor)).otherwise(out)
    return out


def measurement_units(rows: DataFrame, factors: dict[str, tuple[str, float]], id_col: str = "measure_id") -> DataFrame:
    """``(record_id, field_name, raw, unit_code, base_value, unique)`` for width_m and width_px, where present.

    Identities: width_px = distance of the two clicks; width_m = that distance with the pixel sizes of the patch. A missing
    pixel size is taken as the usual one (the median over all rows). A unit right behind the number outweighs the unit
    column and the note, which may mislead and only decide ties. Numbers may have a decimal comma. Text without a number,
    null, blank and NaN are not present. Rows delivered twice count once. An empty table gives an empty one.
    """
    lengths, pixels = codes_of(factors, "m", WIDTH_CODES, ("deg",)), codes_of(factors, "px", PIXEL_CODES)
    typed = F.regexp_extract("width_m", r"^\s*([+-]?[0-9]+(?:[.,][0-9]+)?|[+-]?[.,][0-9]+)\s*(.*)$", 1)
    behind = F.regexp_extract("width_m", r"^\s*([+-]?[0-9]+(?:[.,][0-9]+)?|[+-]?[.,][0-9]+)\s*(.*)$", 2)
    wanted = ("click1_x_px", "click1_y_px", "click2_x_px", "click2_y_px", "width_px", "pixel_size_x_m", "pixel_size_y_m")
    df = rows.select(F.col(id_col).alias("record_id"), *[number(F.col(c)).alias(c) for c in wanted], F.replace(typed, F.lit(","), F.lit(".")).try_cast("double").alias("width"),
                     unit_of_text(behind).alias("said_behind"), unit_of_text(clean(F.col("crs_linear_unit"))).alias("said_column"), F.lower("note").alias("note"))
    usual = df.agg(F.percentile_approx("pixel_size_x_m", 0.5, 10000).alias("usual"))
    df = df.crossJoin(F.broadcast(usual))  # one row
    dx, dy = F.col("click1_x_px") - F.col("click2_x_px"), F.col("click1_y_px") - F.col("click2_y_px")
    sx, sy = F.coalesce("pixel_size_x_m", "pixel_size_y_m", "usual"), F.coalesce("pixel_size_y_m", "pixel_size_x_m", "usual")
    df = df.withColumn("clicks", F.hypot(dx, dy)).withColumn("sized", F.col("pixel_size_x_m").isNotNull() | F.col("pixel_size_y_m").isNotNull())
    logs = {"l_clicks": F.col("clicks"), "l_ground": F.hypot(dx * sx, dy * sy), "l_px": F.abs("width_px"), "l_width": F.abs("width"), "l_size": F.sqrt(sx * sy)}
    df = df.withColumns({k: _log(v) for k, v in logs.items()})
    df = df.withColumn("screen", F.col("note").rlike(SCREEN_WORDS)).withColumn("said_note", unit_of_text(F.regexp_extract("note", r"(?:^width in|entered as|value is|^breite in) (.*?)(?: not .*| abgelesen)?$", 1)))
    combos = []
    for s, w in product(pixels, lengths):
        width_px, width = F.col("l_px") + math.log10(factors[s][1]), F.col("l_width") + math.log10(factors[w][1])
        combos.append(((s, w), [
            _off(width_px, F.col("l_clicks"), 0.05),
            F.when(F.col("sized"), _off(width, F.col("l_ground"), 0.04)).otherwise(_off(width, F.col("l_ground"), 0.12)),
            F.when(F.col("l_clicks").isNull(), _off(width, width_px + F.col("l_size"), 0.12)),
            F.when(F.col("screen") != F.lit(s == "screen_px"), 1.0),
            _said(F.col("said_behind"), w, 6.0), _said(F.col("said_column"), w, 0.5), _said(F.col("said_note"), w, 1.5),
            F.lit((0.0 if s == "px" else 0.5) + (0.0 if w == "m" else 0.5)),
        ]))
    costs, best = best_combination(combos)
    df = df.withColumn("best_costs", costs).withColumn("best", best)
    out = df.select("record_id", F.explode(F.array(
        F.struct(F.lit("width_px").alias("field_name"), F.col("width_px").alias("raw"), F.col("best.units")[0].alias("unit_code"), (F.col("clicks").isNotNull() & (F.col("best.margins")[0] >= MARGIN)).alias("unique")),
        F.struct(F.lit("width_m").alias("field_name"), F.col("width").alias("raw"), F.col("best.units")[1].alias("unit_code"), (F.coalesce("clicks", "width_px").isNotNull() & (F.col("best.margins")[1] >= MARGIN)).alias("unique")),
    )).alias("r")).select("record_id", "r.*").where("raw is not null")
    return out.select("record_id", "field_name", "raw", "unit_code", (F.col("raw") * _factor(factors, F.col("unit_code"))).alias("base_value"), "unique").distinct()
