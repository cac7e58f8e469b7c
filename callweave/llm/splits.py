"""Problem 2: splits that keep related records together.

State is a table of records: each one's component, split and stratum. A batch is joined to it by the keys that records
share; components are contracted to single nodes first, so only what the batch touches is walked. Existing components
keep their split. A merge of components with different splits is not settled silently: its records keep what they
had, the component is quarantined, and new records in a quarantined component get no split (null). New components fill
the deficits of the splits, per stratum, in an order that depends on their ids only. What a batch decides depends on it
and on the state, on nothing that comes later.

Nulls: a record without an id is left out; one without a key is a component of its own; a null stratum is a stratum.
Repeated rows count once; a record keeps the stratum it was first stored with. Empty batches change nothing. Extra
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm.components import components
from callweave.operators.ordered import null_safe_join, running_count
from callweave.session import durable, shared_dir

STATE = "record string, component string, split string, status string, stratum string"


def plain_id(col: str) -> Column:
    """Lower case without blanks; null if nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(F.col(col), r"(?U)\s+", "")), F.lit(""))


def recording_prefix(col: str) -> Column:
    """The file name of a path in any notation, up to its first underscore."""
    name = F.element_at(F.split(F.lower(F.trim(F.col(col))), r"[/\\]+"), -1)
    return F.nullif(F.trim(F.substring_index(name, "_", 1)), F.lit(""))


def caller_reference(col: str) -> Column:
    """``c`` and eight hex digits, whatever stood between; null for anything that is no reference."""
    bare = F.regexp_replace(F.lower(F.col(col)), r"(?U)[^\p{L}\p{N}]+", "")
    return F.when(bare.rlike(r"^c[0-9a-f]{8}$"), bare)


def plain_partition(col: str) -> Column:
    return F.nullif(F.regexp_replace(F.lower(F.regexp_replace(F.col(col), r"(?U)^\s+|\s+$", "")), r"(?U)[\s\-]+", "_"), F.lit(""))


def plain_gender(col: str) -> Column:
    g = F.lower(F.regexp_replace(F.col(col), r"(?U)\s+", ""))
    return F.when(g.isin("f", "female", "여", "여성"), "F").when(g.isin("m", "male", "남", "남성"), "M").otherwise("unknown")


def call_edges(calls: DataFrame) -> DataFrame:
    """``record`` and ``key`` for every call: its recording prefix and its caller reference. A call with neither has
    one row with a null key."""
    keys = F.array(
        F.concat(F.lit("p:"), recording_prefix("wav_relative_path")), F.concat(F.lit("c:"), caller_reference("caller_ref"))
    )
    return calls.select(plain_id("call_id").alias("record"), F.explode_outer(F.array_compact(keys)).alias("key")).where("record is not null").distinct()


def divided_groups(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Records of the components whose rows lie in more than one partition. ``parts``: record and partition, rows
    with a null partition count as none."""
    return divided(components(edges, "record", "key"), parts)


def divided(comp: DataFrame, parts: DataFrame) -> DataFrame:
    """The same from a table of records and their components."""
    placed = comp.join(parts.where("partition is not null").distinct(), "record")
    torn = placed.groupBy("component").agg(F.min("partition").alias("a"), F.max("partition").alias("b")).where("a <> b").select("component")
    return comp.join(torn, "component", "left_semi")


def assign_splits(state: DataFrame | None, keys_seen: DataFrame | None, edges: DataFrame, strata: DataFrame, shares: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    """One batch. ``state``: see STATE; ``keys_seen``: component and key of all before; ``edges``: record and key of the
    batch; ``strata``: record and stratum of its records, one row a record. Returns the new state and the new keys table,
    both written to the shared folder."""
    spark = edges.sparkSession
    shared_dir(spark)
    if state is None or keys_seen is None:
        comp = components(edges, "record", "key").withColumnRenamed("component", "root").join(strata, "record", "left").checkpoint()
        placed = fill_deficits(_new_wholes(comp), spark.createDataFrame([], STATE), shares)
        after = comp.join(placed, "root").select("record", F.col("root").alias("component"), "split", F.lit("new").alias("status"), "stratum")
        after = durable(after, "splits")
        return after, durable(edges.where("key is not null").join(after.select("record", "component"), "record").select("component", "key").distinct(), "split-keys")
    # nodes: known components under their own name, records not seen before under theirs
    # each step is used several times below: written once, so that no plan holds another one twice
    known = state.select("record", F.col("component").alias("_c"))
    batch = edges.join(known, "record", "left").select(
        F.coalesce(F.concat(F.lit("C "), F.col("_c")), F.concat(F.lit("R "), F.col("record"))).alias("node"), "record", "key"
    ).checkpoint()
    touched = keys_seen.join(batch.select("key").where("key is not null").distinct(), "key", "left_semi").select(
        F.concat(F.lit("C "), F.col("component")).alias("node"), "key"
    )
    comp = components(batch.select("node", "key").unionByName(touched), "node", "key").withColumnRenamed("component", "root").checkpoint()
    # what each new whole holds of known components
    held = comp.where("node like 'C %'").select(F.substring("node", 3, 1 << 30).alias("component"), "root")
    held = (
        held.join(state.groupBy("component").agg(F.min("split").alias("low"), F.max("split").alias("high"), F.max(F.col("status") == "quarantined").alias("was")), "component")
        .checkpoint()
    )
    verdict = held.groupBy("root").agg(
        F.min("low").alias("split"),
        (F.coalesce(F.min("low") != F.max("high"), F.lit(False)) | F.max("was")).alias("torn"),
        F.min("component").alias("component"),
    )
    fresh = comp.where("node like 'R %'").select(F.substring("node", 3, 1 << 30).alias("record"), "root").join(strata, "record", "left").checkpoint()
    new = _new_wholes(fresh.join(held.select("root").distinct(), "root", "left_anti"))
    placed = fill_deficits(new, state, shares)
    whole = verdict.select("root", "component", F.when(~F.col("torn"), F.col("split")).alias("split"), F.when(F.col("torn"), "quarantined").otherwise("kept").alias("status")).unionByName(
        placed.select("root", "component", "split", F.lit("new").alias("status"))
    ).checkpoint()
    # rows: new records take their whole's component and split, known ones keep their split
    added = fresh.join(whole, "root").select("record", "component", "split", "status", "stratum")
    renamed = held.select(F.col("component").alias("_old"), "root").join(whole, "root").select("_old", F.col("component").alias("_new"), F.col("status").alias("_status"))
    kept = state.join(renamed, F.col("component") == F.col("_old"), "left").select(
        "record", F.coalesce("_new", "component").alias("component"), "split", F.coalesce("_status", "status").alias("status"), "stratum"
    )
    after = durable(kept.unionByName(added), "splits")
    keys_after = (
        keys_seen.join(renamed, F.col("component") == F.col("_old"), "left")
        .select(F.coalesce("_new", "component").alias("component"), "key")
        .unionByName(edges.where("key is not null").join(after.select("record", "component"), "record").select("component", "key"))
        .distinct()
    )
    return after, durable(keys_after, "split-keys")


def _new_wholes(fresh: DataFrame) -> DataFrame:
    """``component, n, stratum, root`` of the components that ``fresh`` (record, root, stratum) makes."""
    return fresh.groupBy("root").agg(F.min("record").alias("component"), F.count(F.lit(1)).alias("n"), F.mode("stratum", True).alias("stratum"))


def fill_deficits(new: DataFrame, have: DataFrame, shares: dict[str, float], width: int = 1 << 22) -> DataFrame:
    """``new``: component, n, stratum, root. Each stratum's components are laid out by the hash of their names; the
    running sum of their sizes is cut at the deficits that the splits have in that stratum. A component goes where its
    middle falls, so no split misses its share by more than one component."""
    total = sum(shares.values())
    laid = running_count(
        new.withColumn("_h", F.pmod(F.xxhash64("component"), F.lit(1 << 31))), ["stratum"], "_h", F.col("n"), "_upto", width, ["component"]
    )
    sums = new.groupBy("stratum").agg(F.sum("n").alias("_new"))
    now = have.groupBy("stratum").agg(
        F.count("split").alias("_have"), *[F.count(F.when(F.col("split") == s, 1)).alias(f"_have_{s}") for s in shares]
    )
    plan = null_safe_join(sums, now, ["stratum"], "left").fillna(0)
    # where nothing is lacking (a split above its share) the others divide what comes
    for s, share in shares.items():
        plan = plan.withColumn(f"_lack_{s}", F.greatest(F.lit(0.0), (F.col("_new") + F.col("_have")) * F.lit(share / total) - F.col(f"_have_{s}")))
    lack = sum((F.col(f"_lack_{s}") for s in shares), F.lit(0.0))
    edge, cut = F.lit(0.0), []
    for s in shares:
        edge = edge + F.col(f"_lack_{s}") / lack * F.col("_new")
        cut.append((s, edge))
    joined = null_safe_join(laid, plan, ["stratum"])
    middle = F.col("_upto") - F.col("n") / 2
    choice = F.lit(list(shares)[-1])
    for s, e in reversed(cut[:-1]):
        choice = F.when(middle < e, s).otherwise(choice)
    return joined.select("component", "root", choice.alias("split"))
