"""Train, validation and test parts that keep related records together, over a persisted table of components.

Records that share an entity are linked through it; components of the links stay in one part. What a call returns is kept and
given to the next: new links merge old components by pointer jumping over the contracted graph of those they touch. A component keeps its part,
drawn or not, also if none of its old records come again; new ones fill what the parts, old records counted, lack of their
shares; a merge of components from different parts is put in quarantine instead of moving records that are in use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.functions.keys import clean, tile_key
from gridwright.operators.components import connected_components
from gridwright.operators.rank import hash_order, prefix_totals
from gridwright.operators.skew import join_hot
from gridwright.session import cut_lineage

PARTS = ("train", "val", "test")
SHARES = (0.6, 0.2, 0.2)
#: The part that each of the five folds stands for.
FOLD_PARTS = {1: "train", 2: "train", 3: "train", 4: "val", 5: "test"}
QUARANTINE = "quarantine"


def image_key(path) -> F.Column:
    """The image file that a path names: its last part without ending, in one spelling."""
    name = F.regexp_replace(F.regexp_replace(clean(path), r"^.*[\\/]", ""), r"\.[A-Za-z]{2,4}$", "")
    return F.coalesce(tile_key(path), F.upper(F.trim(name)))


def patch_entities(patches: DataFrame) -> DataFrame:
    """``(item, entities, value)`` of patches: the sheet and the image file each is of, and its fold."""
    tile, image = F.coalesce(tile_key(F.col("tile_shortname")), F.upper(clean(F.col("tile_shortname")))), image_key(F.col("image_path"))
    entities = F.array_compact(F.array(F.concat(F.lit("tile:"), tile), F.concat(F.lit("image:"), image)))
    return patches.where(F.col("patch_key").isNotNull()).select(F.col("patch_key").alias("item"), entities.alias("entities"), F.col("split_fold").alias("value"))


def component_table(items: DataFrame, before: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """``(entity, component)`` for all entities of ``items`` and of the table ``before``, merged.

    Only one link is kept for each pair of entities that meet, so an entity with a third of all items is one node with as
    many links as it has partners. An item's entities are linked in a chain. Entities that ``before`` knows stand for their
    component, so only the components that ``items`` touches are merged and the work goes with the new links; a component is
    named by its least entity, and keeps its name unless it grows a lesser one. ``links`` (``entity, component``) ties
    entities to components of ``before``. Items without entities give no rows.
    """
    pairs = items.where(F.size("entities") >= 1).select(
        F.explode(F.transform(F.sequence(F.lit(1), F.size("entities")), lambda i: F.struct(F.element_at("entities", F.greatest(i - 1, F.lit(1))).alias("a"), F.element_at("entities", i).alias("b")))).alias("p")
    )
    new = pairs.select("p.a", "p.b").distinct()
    if before is None:
        return connected_components(new, "a", "b").select(F.col("node").alias("entity"), "component")
    if links is not None:
        new = new.union(links.select(F.col("entity").alias("a"), F.col("component").alias("b")).distinct())
    for end in ("a", "b"):
        known = before.select(F.col("entity").alias(end), F.col("component").alias("_known"))
        new = new.join(known, end, "left").withColumn(end, F.coalesce("_known", end)).drop("_known")
    merged = connected_components(new.distinct(), "a", "b")
    names = merged.select(F.col("node").alias("component"), F.col("component").alias("_now"))
    old = before.join(names, "component", "left").select("entity", F.coalesce("_now", "component").alias("component"))
    fresh = merged.join(before.select(F.col("entity").alias("node")), "node", "left_anti").select(F.col("node").alias("entity"), "component")
    return cut_lineage(old.union(fresh))


def assign(
    items: DataFrame, part_of: dict[int, str] | None = None, before: DataFrame | None = None, shares: tuple[float, ...] = SHARES, seed: int = 1, earlier: tuple[DataFrame, DataFrame, DataFrame] | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(items, components, table)`` for ``items`` with ``item, entities, value``.

    items: ``item, component, part``. components: ``component, first_item, items, values, part, state``, a row for each
    group; ``values`` is the sorted array of the different values its items start from, state is kept (all in one part
    already), new (none has a value) or quarantine (values differ), whose part is quarantine too. table: ``entity,
    component``.

    ``earlier`` is what the call before returned, written and read again: all three results then hold the old items too.
    An old group keeps its part, whether it came from values or was drawn; it goes to quarantine if it is linked to a group
    of another part or gets a value that stands for one. Old items count in the parts' sizes, and one given again counts as
    it is now, but stays with its old group. ``before`` is a table alone: it links entities, and no part is known from it.

    ``part_of`` says which part a value stands for (each value for itself, if not given); a group whose values differ is in
    quarantine even where they stand for one part, as its items aren't together. New groups, in random order, fill the
    parts' deficits end to end by prefix sums, so the shares are met up to a group's size; groups that are larger than what
    lacks land where their first item does. Items without entities are groups of their own. Null items are left out; an
    item given twice counts twice in ``items``. An empty table gives empty ones.
    """
    items = cut_lineage(items.select("item", "entities", "value"))
    keyed = items.withColumn("entity", F.when(F.size("entities") >= 1, F.element_at("entities", 1)))
    links = None
    if earlier is not None:
        old_items, old_groups, before = earlier
        # an item given again links its old group to what it is of now
        again = keyed.select("item", "entity").distinct().join(old_items.select("item", F.col("component").alias("_old")).distinct(), "item")
        links = again.where("entity is not null").select("entity", F.col("_old").alias("component"))
    table = component_table(items, before, links)
    members = join_hot(keyed, table, ["entity"], "item", "left")
    alone = F.concat(F.lit("item:"), F.col("item").cast("string"))
    if earlier is None:
        members = members.select("item", "value", F.coalesce("component", alone).alias("component"))
    else:
        # an old group's name is one of its entities, or that of an item without any
        moved = table.select(F.col("entity").alias("_old"), F.col("component").alias("_now"))
        now = F.coalesce("_now", "_old")
        back = again.where("entity is null").join(moved, "_old", "left").select("item", now.alias("_back"))
        members = members.join(back, "item", "left").select("item", "value", F.coalesce("component", "_back", alone).alias("component"))
        rest = old_items.join(items.select("item").distinct(), "item", "left_anti").select("item", F.col("component").alias("_old"))
        rest = join_hot(rest, moved, ["_old"], "item", "left")
        members = members.union(rest.select("item", F.lit(None).cast(items.schema["value"].dataType), now))
    groups = members.groupBy("component").agg(F.min("item").alias("first_item"), F.count(F.lit(1)).alias("items"), F.array_sort(F.collect_set("value")).alias("values"))
    held = F.array().cast("array<string>")
    if earlier is not None:
        known = old_groups.join(moved, F.col("component") == F.col("_old"), "left").select(F.coalesce("_now", "component").alias("component"), "values", "part")
        known = known.groupBy("component").agg(F.flatten(F.collect_set("values")).alias("_values"), F.collect_set("part").alias("_held"))
        groups = groups.join(known, "component", "left").withColumn("values", F.array_sort(F.array_distinct(F.concat("values", F.coalesce("_values", F.expr("slice(values, 1, 0)"))))))
        held = F.coalesce("_held", held)
    groups = groups.select("component", "first_item", "items", "values", held.alias("_held"))
    part = F.try_element_at("values", F.lit(1)).cast("string")
    if part_of is not None:
        named = F.lit(None).cast("string")
        for value, name in part_of.items():
            named = F.when(F.try_element_at("values", F.lit(1)) == value, name).otherwise(named)
        part = named
    # the part known from the value and those known from before: more than one contradict each other
    held = F.array_distinct(F.array_compact(F.concat("_held", F.array(part))))
    groups = groups.withColumn("_held", held)
    apart = (F.size("values") > 1) | (F.size("_held") > 1) | F.array_contains("_held", QUARANTINE)
    groups = groups.withColumn("state", F.when(apart, QUARANTINE).when((F.size("values") == 1) | (F.size("_held") == 1), "kept").otherwise("new"))
    groups = groups.withColumn("part", F.when(F.col("state") == QUARANTINE, QUARANTINE).when(F.size("_held") == 1, F.try_element_at("_held", F.lit(1)))).drop("_held")
    groups = cut_lineage(groups)
    sizes = {r["part"]: r["items"] for r in groups.groupBy("part").agg(F.sum("items").alias("items")).collect() if r["part"] in (*PARTS, None)}
    total = sum(sizes.values())
    lacks = [max(0.0, share * total - sizes.get(p, 0)) for p, share in zip(PARTS, shares)]
    scale = sizes.get(None, 0) / sum(lacks) if sum(lacks) else 0.0
    fresh = groups.where("part is null").withColumn("_order", hash_order(F.col("component"), seed=seed))
    fresh = prefix_totals(fresh, "_order", ["component"], "items", "_before")
    chosen, end = F.lit(PARTS[-1]), sum(lacks) * scale
    for name, lack in reversed(list(zip(PARTS, lacks))[:-1]):
        end -= lacks[PARTS.index(name) + 1] * scale
        chosen = F.when(F.col("_before") < end, name).otherwise(chosen)
    fresh = fresh.select("component", "first_item", "items", "values", chosen.alias("part"), "state")
    done = groups.where("part is not null").select("component", "first_item", "items", "values", "part", "state").union(fresh)
    out = join_hot(members, done.select("component", "part"), ["component"], "item", sizes=groups.select("component", "items"), rows="items").select("item", "component", "part")
    return out, done, table


RESULTS = ("items", "components", "table")


def save(results: tuple[DataFrame, DataFrame, DataFrame], folder: str) -> None:
    """Write what :func:`assign` gave to ``folder``, on storage that all executors share, for the next call."""
    for name, df in zip(RESULTS, results):
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What :func:`save` wrote, to be given to :func:`assign` as ``earlier``."""
    return tuple(spark.read.parquet(f"{folder}/{name}") for name in RESULTS)
