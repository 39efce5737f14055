"""Queries of this package: each takes a session and a directory of tables and reads its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.llm import diverse, encode, grouped_splits, overlap, packing, prose, sampling, survivor
from gridwright.session import cut_lineage, shared_folder, table


def _sample(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return sampling.sample(table(spark, sf, "width_tasks"), table(spark, sf, "sampling_targets"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Targets whose run has fewer different tasks than the floor or the share of the size asks for."""
    report = sampling.cells_and_report(table(spark, sf, "width_tasks"), table(spark, sf, "sampling_targets"))[2]
    return report.where("short").select("run_id", "field_name", "category")


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    """All targets with the tasks available and drawn and what is missing."""
    return sampling.cells_and_report(table(spark, sf, "width_tasks"), table(spark, sf, "sampling_targets"))[2]


def p1_targets(spark: SparkSession, sf: str) -> DataFrame:
    """What each target asks for and how many tasks there are for it."""
    report = sampling.cells_and_report(table(spark, sf, "width_tasks"), table(spark, sf, "sampling_targets"))[2]
    return report.select("run_id", "field_name", "category", F.round("required", 6).alias("required"), "available", "short")


def p1_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The tasks drawn for each run."""
    return _sample(spark, sf)[0]


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of a train and a held-out record of a run that describe the same edition of a sheet."""
    members, _ = overlap.classes(table(spark, sf, "split_records"))
    return overlap.cross_split_pairs(members).select("record_a", "record_b").distinct()


def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    """What of each held-out split and source is also in train, run by run."""
    return overlap.overlap_report(*overlap.classes(table(spark, sf, "split_records")))


def p3_audit(spark: SparkSession, sf: str) -> DataFrame:
    """The recorded violations of each run beside the pairs of different splits nearer than its distance, and beside the
    overlaps found. Records without bounds are in no near pair."""
    records, audits = table(spark, sf, "split_records"), table(spark, sf, "split_audits")
    found = overlap.overlap_counts(overlap.classes(records)[0])
    near = overlap.split_minima(records, audits).select("run_id", "near_pairs")
    out = audits.select("run_id", F.col("violations_count").alias("recorded")).join(found, "run_id", "left").join(near, "run_id", "left")
    return out.select("run_id", "recorded", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("near_pairs", "pairs_found", "held_out_found")])


def p3_minima(spark: SparkSession, sf: str) -> DataFrame:
    """The least distance between each two splits of a run, worked out from its records, beside the recorded figures.

    status is the first that holds for one of the three figures: stale, mis-scaled (1000 times too large or small), not
    recorded; else agrees.
    """
    audits = table(spark, sf, "split_audits")
    kinds = [f"min_{t}_km" for t in overlap.PAIR_TYPES]
    ours = overlap.split_minima(table(spark, sf, "split_records"), audits).select("run_id", "near_pairs", *[F.round(k, 6).alias(k) for k in kinds])
    told = audits.select("run_id", "violations_count", *[F.when(~F.isnan(k), F.col(k)).alias(f"recorded_{k}") for k in kinds])
    near = lambda x, y: F.abs(x - y) <= 0.001 * F.greatest(F.lit(1.0), y)
    state = []
    for k in kinds:
        x, y = F.col(f"recorded_{k}"), F.col(k)
        state.append(F.when(x.isNull() & y.isNotNull(), "not recorded").when(x.isNull() | F.coalesce(near(x, y), F.lit(False)), "agrees").when((y > 0) & (near(x, y * 1000) | (F.abs(x * 1000 - y) <= 0.001 * y)), "mis-scaled").otherwise("stale"))
    order = ("stale", "mis-scaled", "not recorded")
    status = F.lit("agrees")
    for name in reversed(order):
        status = F.when(F.array_contains(F.array(*state), name), name).otherwise(status)
    return ours.join(told, "run_id").withColumn("status", status)


def p4_survivors(spark: SparkSession, sf: str) -> DataFrame:
    """One fused record for each sheet."""
    return survivor.survivors(table(spark, sf, "real_tiles_metadata"), table(spark, sf, "source_trust"), table(spark, sf, "unit_factors"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """The surviving record of each sheet with two or more, after all its records are fused."""
    # written first: the planner would leave out the choice of values for a query that shows ids only
    fused = cut_lineage(p4_survivors(spark, sf))
    return fused.where("records >= 2").select("group_id", "best_id")


def p5_varied(spark: SparkSession, sf: str) -> DataFrame:
    """A varied subset of both pools of sheets; the limit of rows is the feature."""
    return diverse.choose_varied(spark, table(spark, sf, "new_all_tiles"), table(spark, sf, "real_tiles_metadata"))


def _assigned(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return grouped_splits.assign(grouped_splits.patch_entities(table(spark, sf, "selected_patches")), grouped_splits.FOLD_PARTS)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of patches that belong together but have different folds."""
    components = _assigned(spark, sf)[1]
    return components.where(F.col("state") == grouped_splits.QUARANTINE).select(F.col("first_item").alias("group_id"))


def p6_splits(spark: SparkSession, sf: str) -> DataFrame:
    """The part of each patch."""
    items, _, _ = _assigned(spark, sf)
    return items.select(F.col("item").alias("patch_key"), "component", "part")


def p6_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Patches and components of each part."""
    components = _assigned(spark, sf)[1]
    return components.groupBy("part", "state").agg(F.count(F.lit(1)).alias("component_count"), F.sum("items").alias("patches"))


def _in_two_batches(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The patches assigned as they arrive: those of the first months, the results written and read again, then only the rest."""
    patches = table(spark, sf, "selected_patches")
    seconds = F.unix_micros(F.col("ingested_at").cast("timestamp"))
    late = F.coalesce(seconds, F.lit(0)) > F.lit(patches.agg(F.percentile_approx(seconds, 0.75)).first()[0] or 0)
    batch = lambda arrived: grouped_splits.patch_entities(patches.where(arrived))
    folder = f"{shared_folder(spark)}/components-{uuid.uuid4().hex}"
    grouped_splits.save(grouped_splits.assign(batch(~late), grouped_splits.FOLD_PARTS), folder)
    return grouped_splits.assign(batch(late), grouped_splits.FOLD_PARTS, earlier=grouped_splits.load(spark, folder))


def p6_second_batch(spark: SparkSession, sf: str) -> DataFrame:
    """The part of each patch after the last quarter arrived as a second batch: parts of the first call hold."""
    return _in_two_batches(spark, sf)[0].select(F.col("item").alias("patch_key"), "component", "part")


def p6_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The groups after two batches, which are those of all patches at once, with their patches and different folds."""
    return _in_two_batches(spark, sf)[1].select(F.col("first_item").alias("group_id"), F.col("items").alias("patches"), F.size("values").alias("folds"))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every text."""
    return encode.encode_texts(table(spark, sf, "documents"))


def _packed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf, "documents")
    return packing.pack_texts(docs, encode.count_tokens(docs))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that had to be cut, as they are longer than a container."""
    return _packed(spark, sf)[0].where("pieces > 1").select(F.col("id").alias("doc_id")).distinct()


def p9_packed(spark: SparkSession, sf: str) -> DataFrame:
    """The container of each piece of text."""
    return _packed(spark, sf)[0].withColumnRenamed("id", "doc_id")


def p9_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Containers, fill and room left, by capacity."""
    runs = _packed(spark, sf)[1]
    total = F.sum(F.col("number") * F.col("capacity"))
    return runs.groupBy("capacity").agg(F.sum("number").alias("containers"), F.sum(F.col("number") * F.col("used")).alias("used"), total.alias("room"), F.round(1 - F.sum(F.col("number") * F.col("used")) / total, 6).alias("unused_share"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that mostly aren't prose, and what they are."""
    return prose.found(prose.classify(table(spark, sf, "documents"), table(spark, sf, "common_words")))


def p10_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """How many texts the trees and the labelling rules take for each kind, and the trees' mean probability."""
    texts = prose.classify(table(spark, sf, "documents"), table(spark, sf, "common_words")).where("kind is not null")
    return texts.groupBy("rule_kind", "kind").agg(F.count(F.lit(1)).alias("texts"), F.round(F.avg("probability"), 4).alias("mean_probability"))


def p10_holdout(spark: SparkSession, sf: str) -> DataFrame:
    """What the trees take the texts read by hand for: counts, mean probability, how far it is from the share that is right."""
    model = prose.fitted(table(spark, sf, "documents"), table(spark, sf, "common_words"))[1]
    return spark.createDataFrame(model.report(), "kind string, taken_for string, texts int, mean_probability double, calibration_gap double")


def p10_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Figures on the words, symbols and line ends of every text."""
    return prose.text_statistics(table(spark, sf, "documents"), table(spark, sf, "common_words"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries by name."""
    named = (p1_found, p1_report, p1_targets, p1_sample, p3_found, p3_report, p3_audit, p3_minima, p4_found, p4_survivors, p5_varied, p6_found, p6_splits, p6_parts, p6_second_batch, p6_groups, p8_ids, p9_found, p9_packed, p9_containers, p10_found, p10_agreement, p10_holdout, p10_stats)
    return {f.__name__: f for f in named}
