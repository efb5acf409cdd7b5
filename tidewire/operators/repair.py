"""Repairs of published rows: what is frozen, what was tried, and proof that nothing else changed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_hash(*columns: str) -> Column:
    """SHA-256 of a row's columns as JSON, nulls included."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def protected(frame: DataFrame, free: Sequence[str]) -> DataFrame:
    """(n, hash): a fingerprint of every column but the free ones, whatever the rows' order."""
    kept = [c for c in frame.columns if c not in free]
    return frame.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*kept).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("hash"))


def freeze(entries: DataFrame, key: str, identity: str, body: str, columns: Sequence[str]) -> DataFrame:
    """(key, request_hash, aliases, least, collides): one target per request key, with its aliases counted and hashed.

    Aliases of one key must make the same request; `collides` tells keys whose bodies differ.
    """
    grouped = entries.groupBy(key).agg(
        F.min(body).alias("_low"), F.max(body).alias("_high"), F.count_distinct(identity).alias("aliases"), F.min(identity).alias("least"),
        F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string").alias("baseline"),
    )
    return grouped.select(key, F.sha2(F.col("_low").cast("string"), 256).alias("request_hash"), "aliases", "least", "baseline", (F.col("_low") != F.col("_high")).alias("collides"))


def unchanged_targets(frozen: DataFrame, rebuilt: DataFrame, key: str) -> DataFrame:
    """Keys of targets that were frozen or rebuilt differently: none, if a manifest still holds."""
    columns = [c for c in frozen.columns if c != key]
    joined = frozen.select(key, row_hash(*columns).alias("was")).join(rebuilt.select(key, row_hash(*columns).alias("now")), key, "full_outer")
    return joined.where(~F.col("was").eqNullSafe(F.col("now"))).select(key, F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").otherwise("changed").alias("state"))


def next_batch(targets: DataFrame, checkpoint: DataFrame, key: str, place: str, most: int = 25) -> DataFrame:
    """The targets to try next: none while a former attempt is unresolved or failed, else the first untried ones."""
    stuck = checkpoint.agg(F.coalesce(F.bool_or(F.col("status") != "succeeded"), F.lit(False)).alias("stuck"))
    fresh = targets.join(checkpoint.select(key).distinct(), key, "left_anti").crossJoin(F.broadcast(stuck)).where(~F.col("stuck")).drop("stuck")
    return fresh.orderBy(place).limit(most)


def invalid_attempts(checkpoint: DataFrame, targets: DataFrame, key: str, hashed: str, succeeded: Column) -> DataFrame:
    """Attempts that no checkpoint may hold: of unknown targets, other requests, unknown states or broken results."""
    joined = checkpoint.alias("c").join(targets.select(F.col(key), F.col(hashed).alias("_want")).alias("t"), key, "left")
    why = (
        F.when(F.col("_want").isNull(), "unknown target")
        .when(~F.col(f"c.{hashed}").eqNullSafe(F.col("_want")), "other request")
        .when(~F.col("status").isin("sending", "succeeded", "failed"), "unknown state")
        .when((F.col("status") == "succeeded") & ~F.coalesce(succeeded, F.lit(False)), "invalid result")
    )
    return joined.withColumn("why", why).where("why IS NOT NULL").select(key, "why")


def progress(targets: DataFrame, checkpoint: DataFrame, key: str) -> DataFrame:
    """(targets, attempted, succeeded, remaining, status) in one row."""
    joined = targets.select(key).join(checkpoint.select(key, "status"), key, "left")
    done = F.count_if(F.col("status") == "succeeded")
    counted = joined.agg(F.count("*").alias("targets"), F.count("status").alias("attempted"), done.alias("succeeded"))
    status = F.when(F.col("attempted") > F.col("succeeded"), "blocked").when(F.col("succeeded") == F.col("targets"), "complete").otherwise("batch_complete")
    return counted.withColumns({"remaining": F.col("targets") - F.col("succeeded"), "status": status})


def apply_result(label: Column, score: Column, reason: Column, new_label: Column, confidence: Column, new_score: Column, human: Column, eligible: Column, least: float = 0.6) -> Column:
    """(label, score, reason) after a result: a confident label replaces the old one, a score needs a label; human labels stay."""
    open_ = eligible & ~F.coalesce(human, F.lit(False)) & new_label.isNotNull()
    sure = open_ & F.coalesce(confidence >= least, F.lit(False))
    found = F.when(sure, new_label).otherwise(label)
    return F.struct(
        found.alias("label"), F.when(open_ & new_score.isNotNull() & found.isNotNull(), new_score).otherwise(score).alias("score"), F.when(sure, F.lit("")).otherwise(reason).alias("reason")
    )


def audit(before: DataFrame, after: DataFrame, key: str, allowed: Sequence[str], targets: DataFrame) -> DataFrame:
    """(key, fault) of rows that a repair may not leave so: gone, new, changed outside the targets or the allowed columns."""
    kept = [c for c in before.columns if c != key and c not in allowed]
    old = before.select(key, row_hash(*kept).alias("o"), row_hash(*allowed).alias("oa"))
    new = after.select(key, row_hash(*kept).alias("n"), row_hash(*allowed).alias("na"))
    joined = old.join(new, key, "full_outer").join(targets.select(key, F.lit(True).alias("t")).distinct(), key, "left")
    fault = (
        F.when(F.col("n").isNull(), "gone")
        .when(F.col("o").isNull(), "new")
        .when(F.col("o") != F.col("n"), "protected column changed")
        .when((F.col("oa") != F.col("na")) & F.col("t").isNull(), "changed without being a target")
    )
    return joined.withColumn("fault", fault).where("fault IS NOT NULL").select(key, "fault")


def reconcile(saved: DataFrame, current: DataFrame, identity: str, hashed: str) -> DataFrame:
    """(identity, status) of saved results: usable, changed since, or of an article that left."""
    joined = saved.select(identity, F.col(hashed).alias("_was")).join(current.select(identity, F.col(hashed).alias("_now"), F.lit(True).alias("_there")), identity, "left")
    status = F.when(F.col("_there").isNull(), "missing").when(F.col("_was") == F.col("_now"), "usable").otherwise("changed")
    return joined.select(identity, status.alias("status"))


def patch(rows: DataFrame, updates: DataFrame, key: str, nested: str, values: Sequence[str]) -> DataFrame:
    """Rows with updated values of themselves and of the copies nested in them; `nested` holds structs with the key and the values."""
    flat = rows.select(F.col(key).alias("_row"), F.posexplode(nested).alias("_at", "_x"))
    changed = flat.join(updates.select(F.col(key).alias("_k"), *(F.col(v).alias(f"_{v}") for v in values)), F.col(f"_x.{key}") == F.col("_k"), "left")
    fields = rows.schema[nested].dataType.elementType.fieldNames()
    fresh = F.struct(*((F.when(F.col("_k").isNotNull(), F.col(f"_{f}")).otherwise(F.col(f"_x.{f}")) if f in values else F.col(f"_x.{f}")).alias(f) for f in fields))
    # A row's copies are as many as a story has members shown in it: a bounded list already.
    lists = changed.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("_at", fresh.alias("x")))).alias("_list"))
    joined = rows.join(lists, F.col(key) == F.col("_row"), "left").join(updates.select(F.col(key).alias("_k"), *(F.col(v).alias(f"_{v}") for v in values)), F.col(key) == F.col("_k"), "left")

    def value(name: str) -> Column:
        if name == nested:
            return F.when(F.col("_row").isNotNull(), F.transform("_list", lambda e: e["x"])).otherwise(F.col(nested))
        return F.when(F.col("_k").isNotNull(), F.col(f"_{name}")).otherwise(F.col(name)) if name in values else F.col(name)

    return joined.select(*(value(c).alias(c) for c in rows.columns))


def lineage(runs: DataFrame, current: int, freeze_run: int, checkpoint: int | None) -> DataFrame:
    """(prior, fault) in one row: the latest earlier run of a freeze, and why it can't be followed, if so.

    `runs` has id, number, freeze, status and conclusion.
    """
    earlier = runs.where((F.col("freeze") == freeze_run) & (F.col("number") < current))
    latest = earlier.agg(F.max_by(F.struct("id", "status", "conclusion"), "number").alias("l"))
    given = F.lit(checkpoint).cast("long")
    fault = (
        F.when(F.col("l").isNull(), F.when(given.isNotNull(), "unexpected checkpoint"))
        .when(~F.col("l.id").cast("long").eqNullSafe(given), "latest checkpoint required")
        .when((F.col("l.status") != "completed") | (F.col("l.conclusion") != "success"), "prior run unresolved")
    )
    return latest.select(F.col("l.id").alias("prior"), fault.alias("fault"))


def same_tree(left: DataFrame, right: DataFrame, path: str, digest: str, critical: str) -> DataFrame:
    """(same,) in one row: whether two lists of files agree where paths match `critical`, with at least one such path."""
    rows = [f.where(F.col(path).rlike(critical)).select(path, F.col(digest).alias(name)) for f, name in ((left, "l"), (right, "r"))]
    joined = rows[0].join(rows[1], path, "full_outer")
    return joined.agg((F.count("l") > 0).alias("some"), F.count_if(~F.col("l").eqNullSafe(F.col("r"))).alias("apart")).select((F.col("some") & (F.col("apart") == 0)).alias("same"))
