"""One surviving record for each group of duplicates, its fields fused from all of them.

Bayesian fusion with copy detection. Sources vote for values; a source's vote counts by its accuracy, and less where it seems
copied. Two sources seem to depend on each other if they share false values: independent ones that are both wrong rarely
agree, copies do; that good sources share true values says nothing. Accuracies, dependence and the probabilities of values
are estimated in turn until the accuracies stand still. The state is a number for each source and each pair of them.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.functions.keys import clean, fold, number, tile_key
from gridwright.operators.skew import join_hot
from gridwright.operators.units import factors_of, tile_metres
from gridwright.session import cut_lineage, shared_folder

#: Assumptions of the model: false values a field can have, share of values a copier copies, chance that two sources depend,
#: accuracy to begin with, and the bounds it is kept in.
FALSE_VALUES, COPY_RATE, PRIOR_DEPENDENT, FIRST_ACCURACY, LEAST_ACCURACY, MOST_ACCURACY = 20, 0.8, 0.1, 0.8, 0.05, 0.99
#: Rounds at most, and the change of an accuracy that counts as none.
ROUNDS, SETTLED = 6, 0.005
#: Rows of the driver's state: one a source, one for each two sources that are ever wrong together. More are an error; 2,000
#: sources fit whatever they share.
MOST_PAIRS = 2_000_000
#: Accuracy by source, dependence by pair.
State = tuple[dict[str, float], dict[tuple[str, str], float]]
FUSED = ("city", "year", "filename", "ul_x", "pixel_width", "source_crs")


def present(value: Column, zero_is_missing: bool = False) -> Column:
    text = clean(value)
    if zero_is_missing:
        return F.when(number(value) != 0, text)
    return text


def _missing_number(value: Column) -> Column:
    return F.when(~F.isnan(value), value.cast("string"))


def record_group(df: DataFrame) -> Column:
    """The sheet a record is of: the first of short name, long name, file name and path that names one."""
    return F.coalesce(*[tile_key(F.col(c)) for c in ("shortname", "longname", "filename", "image_path")])


def copying(same_false: Column, different_false: Column) -> Column:
    """The probability that two sources depend, from the values they share and don't share where both are wrong."""
    chance = 1 / FALSE_VALUES
    odds = F.lit(math.log(PRIOR_DEPENDENT / (1 - PRIOR_DEPENDENT))) + same_false * math.log((COPY_RATE + (1 - COPY_RATE) * chance) / chance) + different_false * math.log(1 - COPY_RATE)
    return 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), odds))))


def vote_confidence(sources: tuple[str, ...], accuracy: dict[str, float], dependence: dict[tuple[str, str], float]) -> float:
    """The logarithmic weights of a value's sources, the more accurate first, each times the chance that it copied none of
    those before it."""
    total, seen = 0.0, []
    for s in sorted(sources, key=lambda s: (-accuracy.get(s, FIRST_ACCURACY), s)):
        a, own = accuracy.get(s, FIRST_ACCURACY), 1.0
        for other in seen:
            own *= 1 - COPY_RATE * dependence.get((min(s, other), max(s, other)), 0.0)
        total += math.log(FALSE_VALUES * a / (1 - a)) * own
        seen.append(s)
    return total


def vote_weights(accuracy: dict[str, float], dependence: dict[tuple[str, str], float]) -> Callable[[Iterable[str]], float]:
    """The weight of a value by its sources."""
    known: dict[tuple[str, ...], float] = {}  # the sets of sources are few

    def weight(sources: Iterable[str]) -> float:
        key = tuple(sources)
        if key not in known:
            known[key] = math.exp(min(300.0, vote_confidence(key, accuracy, dependence)))
        return known[key]

    return weight


def weighted(votes: DataFrame, accuracy: dict[str, float], dependence: dict[tuple[str, str], float]) -> DataFrame:
    """``votes`` with the ``weight`` of each value."""

    @F.pandas_udf("double")
    def weight(sources: pd.Series) -> pd.Series:
        return pd.Series(list(map(vote_weights(accuracy, dependence), sources)), dtype="float64")

    return votes.withColumn("weight", weight("sources"))


def _all_weight() -> Column:
    """The weights of a field's values, said or not, summed."""
    return F.sum("weight") + F.greatest(F.lit(FALSE_VALUES + 1) - F.count(F.lit(1)), F.lit(0))


def believed_values(votes: DataFrame, accuracy: dict[str, float], dependence: dict[tuple[str, str], float]) -> DataFrame:
    """``votes`` (``tile, field, value, sources``, ...) with ``belief``, the posterior probability of each value."""
    scored = weighted(votes, accuracy, dependence)
    totals = scored.groupBy("tile", "field").agg(_all_weight().alias("all_weight"))
    met = join_hot(scored, totals, ["tile", "field"], "value")
    return met.withColumn("belief", F.col("weight") / F.col("all_weight")).drop("weight", "all_weight")


def chosen_values(votes: DataFrame, accuracy: dict[str, float], dependence: dict[tuple[str, str], float]) -> DataFrame:
    """``tile, field, shown, belief`` of the value of maximum posterior probability, then of the best trusted one, for each
    field. The order by belief is that by weight, so one aggregation does."""
    best = F.struct("weight", (-F.col("rank")).alias("r"), "value")
    return weighted(votes, accuracy, dependence).groupBy("tile", "field").agg(F.max_by("shown", best).alias("shown"), (F.max("weight") / _all_weight()).alias("belief"))


def shapes_of(votes: DataFrame) -> DataFrame:
    """``shape, fields``: the sets of sources of a field's values, with the values of each set, and how many fields have them.

    Beliefs follow from the shape alone, so accuracies and dependence are estimated over shapes, which are few, not over votes.
    """
    sets = votes.groupBy("tile", "field", "sources").agg(F.count(F.lit(1)).alias("n"))
    shapes = sets.groupBy("tile", "field").agg(F.array_sort(F.collect_list(F.struct("sources", "n"))).alias("shape"))
    return shapes.groupBy("shape").agg(F.count(F.lit(1)).alias("fields"))


def estimated(shapes: DataFrame, accuracy: dict[str, float], dependence: dict[tuple[str, str], float]) -> tuple[dict[str, float], dict[tuple[str, str], float]]:
    """Accuracy by source and dependence by pair, from the beliefs that the given ones lead to.

    What comes to the driver is a row for each source and for each two sources that are ever wrong together.
    """

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = vote_weights(accuracy, dependence)
        sums: dict[tuple[str, str], list] = defaultdict(lambda: [0.0, 0, 0, 0])  # belief, values, both say a false one, both are wrong
        for row in (r for batch in batches for r in batch.to_pylist()):
            sets = [(x["sources"], x["n"], weight(x["sources"])) for x in row["shape"]]
            whole = sum(n * w for _, n, w in sets) + max(0, FALSE_VALUES + 1 - sum(n for _, n, _ in sets))
            in_error: set[str] = set()
            for sources, n, w in sets:
                for s in sources:
                    sums[s, s][0] += w / whole * n * row["fields"]
                    sums[s, s][1] += n * row["fields"]
                if w / whole < 0.5:
                    in_error.update(sources)
                    for pair in combinations(sources, 2):
                        sums[pair][2] += n * row["fields"]
            for pair in combinations(sorted(in_error), 2):
                sums[pair][3] += row["fields"]
        rows = [(*pair, *x) for pair, x in sums.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["s", "t", "belief", "n", "wrong", "both"])

    summed = shapes.mapInArrow(figures, "s string, t string, belief double, n long, wrong long, both long").groupBy("s", "t").agg(*[F.sum(c).alias(c) for c in ("belief", "n", "wrong", "both")])
    apart = F.greatest(F.lit(0), F.col("both") - F.col("wrong"))
    rows = summed.select("s", "t", "belief", "n", "both", copying(F.col("wrong"), apart).alias("p")).where("s = t or both > 0").limit(MOST_PAIRS + 1).collect()
    if len(rows) > MOST_PAIRS:
        raise ValueError(f"more than {MOST_PAIRS} pairs of sources")
    found = {r["s"]: min(MOST_ACCURACY, max(LEAST_ACCURACY, r["belief"] / r["n"])) for r in rows if r["s"] == r["t"] and r["n"]}
    return found, {(r["s"], r["t"]): r["p"] for r in rows if r["s"] != r["t"]}


def keyed_records(records: DataFrame, source_trust: DataFrame, unit_factors: DataFrame | None = None) -> DataFrame:
    """``record_id, tile, source, rank, recorded_at, present`` and the six fields, null where they have no value.

    With ``unit_factors`` also ``ul_x_m, pixel_width_m``, the lengths in metres, told by physical identities.
    """
    trust = source_trust.where("source is not null").groupBy("source").agg(F.min("trust_rank").cast("long").alias("_rank"))
    records = records.where(F.col("record_id").isNotNull())
    sizes = records.groupBy("source").agg(F.count(F.lit(1)).alias("_rows"))
    metres: tuple[str, ...] = ()
    if unit_factors is not None:
        metres = ("ul_x_m", "pixel_width_m")
        records = tile_metres(records, factors_of(unit_factors), ("shortname", "longname", "filename", "image_path", "city", "year", "source_crs", "source", "recorded_at"))
    values = {"city": present(F.col("city")), "year": present(F.col("year"), True), "filename": present(F.col("filename")), "ul_x": _missing_number(F.col("ul_x")),
              "pixel_width": _missing_number(F.col("pixel_width")), "source_crs": present(F.col("source_crs"))}
    rows = records.select("record_id", record_group(records).alias("tile"), "recorded_at", "source", *metres, *[v.alias(k) for k, v in values.items()]).where("tile is not null")
    # a source may have a third of the rows; a hot one's row of trust is copied
    rows = join_hot(rows, trust, ["source"], "record_id", "left", sizes).withColumn("rank", F.coalesce("_rank", F.lit(2**31 - 1))).drop("_rank")
    return rows.withColumn("present", sum((F.col(c).isNotNull().cast("int") for c in FUSED), F.lit(0)))


def best_records(records: DataFrame, source_trust: DataFrame) -> DataFrame:
    """``tile, group_id, best_id, records``: one row for each sheet that a record names, by one aggregation.

    best_id is the record with most of the six fields present, then the smaller trust_rank, the later recorded_at, the
    smaller record_id. See :func:`survivors` for what isn't a value and what is in no group.
    """
    return _best(keyed_records(records, source_trust))


def _best(rows: DataFrame) -> DataFrame:
    order = F.struct("present", (-F.col("rank")).alias("r"), "recorded_at", (-F.col("record_id")).alias("i"))
    return rows.groupBy("tile").agg(F.min("record_id").alias("group_id"), F.max_by("record_id", order).alias("best_id"), F.count_distinct("record_id").alias("records"))


def claims_of(rows: DataFrame) -> DataFrame:
    """``tile, record_id, recorded_at, source, rank, field, value, shown``: what each record says, in a form to compare."""
    forms = {
        "city": (fold(F.col("city")), F.col("city")),
        "year": (F.col("year").try_cast("double").cast("int").cast("string"), F.col("year").try_cast("double").cast("int").cast("string")),
        "filename": (F.lower(F.regexp_replace("filename", r"\.[A-Za-z]+$", "")), F.col("filename")),
        "ul_x": (F.round(F.col("ul_x_m") / 1000).cast("bigint").cast("string"), F.col("ul_x_m").cast("string")),
        "pixel_width": (F.round(F.log(F.abs("pixel_width_m")) * 100).cast("bigint").cast("string"), F.col("pixel_width_m").cast("string")),
        "source_crs": (F.regexp_replace(F.regexp_replace(F.upper("source_crs"), "WGS ?84", "4326"), r"[^0-9]", ""), F.col("source_crs")),
    }
    claim = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), form.alias("value"), shown.alias("shown")) for f, (form, shown) in forms.items()]))
    return rows.select("tile", "record_id", "recorded_at", F.coalesce("source", F.lit("")).alias("source"), "rank", claim.alias("c")).select("tile", "record_id", "recorded_at", "source", "rank", "c.*").where("value is not null and value <> ''")


def votes_of(claims: DataFrame) -> DataFrame:
    """``tile, field, value, sources, rank, shown``: each value of a field once, from ``claims``; see :func:`claims_of`.

    They are written to the shared folder and read again, as a table: that is smaller than a checkpoint, and made once.
    """
    # of the records that show a value, the best trusted one's spelling
    shown = F.max_by("shown", F.struct((-F.col("rank")).alias("r"), "recorded_at", (-F.col("record_id")).alias("i")))
    votes = claims.groupBy("tile", "field", "value").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.min("rank").alias("rank"), shown.alias("shown"))
    folder = f"{shared_folder(claims.sparkSession)}/votes-{uuid.uuid4().hex}"
    votes.write.parquet(folder)
    return claims.sparkSession.read.parquet(folder)


def settled(votes: DataFrame, rounds: int = ROUNDS) -> tuple[State, State]:
    """The accuracies and dependence to believe values by, and those estimated from these beliefs, which differ little."""
    shapes = cut_lineage(shapes_of(votes))
    state: State = ({}, {})
    for _ in range(max(1, rounds)):
        before, state = state, estimated(shapes, *state)
        if all(abs(a - before[0].get(s, FIRST_ACCURACY)) < SETTLED for s, a in state[0].items()):
            break
    return before, state


def fuse(claims: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, dict[str, float], dict[tuple[str, str], float]]:
    """``(votes with belief, accuracy by source, dependence by pair)`` from ``claims``; see :func:`claims_of`."""
    votes = votes_of(claims)
    before, (accuracy, dependence) = settled(votes, rounds)
    return believed_values(votes, *before), accuracy, dependence


def survivors(records: DataFrame, source_trust: DataFrame, unit_factors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row for each sheet that a record names: ``tile, group_id, best_id, records, city, year, filename, ul_x,
    pixel_width, source_crs, confidence``.

    group_id is the smallest record_id. best_id is the record of :func:`best_records`. The fields are the values of maximum
    posterior probability, written as in the best trusted record that has them; ul_x and pixel_width in metres. Lengths count
    as one value if they agree to a kilometre (pixel sizes to a per cent). confidence is the mean probability of the fields
    present.

    Null, NaN, blank, year 0 and words or signs for "no value" aren't values. Records that name no sheet, and null ids, are
    in no group. Sources without a rank come last; each votes for itself, and records without a source vote as one. A group
    with no values keeps null fields. A record given twice counts once. An empty table gives an empty one. Groups are never
    gathered: votes are counted by group, field and value with map-side partial sums.
    """
    rows = keyed_records(records, source_trust, unit_factors)
    votes = votes_of(claims_of(rows))
    chosen = chosen_values(votes, *settled(votes, rounds)[0])
    fused = chosen.groupBy("tile").agg(*[F.max(F.when(F.col("field") == f, F.col("shown"))).alias(f) for f in FUSED], F.avg("belief").alias("confidence"))
    out = _best(keyed_records(records, source_trust)).join(fused, "tile", "left")
    kinds = {"year": "int", "ul_x": "double", "pixel_width": "double"}
    return out.select("tile", "group_id", "best_id", "records", *[F.col(f).cast(kinds.get(f, "string")).alias(f) for f in FUSED], "confidence")
