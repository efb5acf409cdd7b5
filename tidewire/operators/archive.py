"""The durable archive: upserts, retention, caches with an end, and what changed between versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days that an article stays, and hours that a date may lie in the future. Fixed values.
RETENTION_DAYS, FUTURE_HOURS = 92, 6


def hours(n: float) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(n * 3600)))


def upsert(
    archived: DataFrame,
    current: DataFrame,
    key: str,
    fresh_first: Sequence[str],
    earliest: Sequence[str] = (),
    union: Sequence[str] = (),
) -> DataFrame:
    """Archived and current rows by key, merged where both have it.

    `fresh_first` columns take the current value unless it is null or an empty text,
    `earliest` the lesser of both, `union` arrays the current values and then the archived
    ones, each once; other columns take the archived value unless null. Keys must be unique
    in either frame.
    """
    old, new = archived.alias("old"), current.alias("new")

    def filled(side: str, name: str) -> Column:
        column = F.col(f"{side}.{name}")
        return F.nullif(column, F.lit("")) if archived.schema[name].dataType.simpleString() == "string" else column

    def merged(name: str) -> Column:
        if name == key:
            return F.coalesce(F.col(f"new.{key}"), F.col(f"old.{key}"))
        if name in earliest:
            return F.least(F.col(f"new.{name}"), F.col(f"old.{name}"))
        if name in union:
            empty = F.array().cast(archived.schema[name].dataType)
            return F.array_distinct(F.concat(F.coalesce(F.col(f"new.{name}"), empty), F.coalesce(F.col(f"old.{name}"), empty)))
        order = ("new", "old") if name in fresh_first else ("old", "new")
        return F.coalesce(*(filled(side, name) for side in order), F.col(f"new.{name}"), F.col(f"old.{name}"))

    joined = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer")
    return joined.select(*(merged(c).alias(c) for c in archived.columns))


def retained(frame: DataFrame, at: Column, now: Column, exempt: Column, refused: Column | None = None, days: int = RETENTION_DAYS) -> DataFrame:
    """Rows to keep: refused ones and those dated past the allowance for the future go first,
    then exempt ones stay whatever their age, others for `days` days. Undated rows stay only if exempt."""
    future = F.coalesce(at > now + hours(FUTURE_HOURS), F.lit(False))
    recent = F.coalesce(at >= now - hours(24 * days), F.lit(False))
    gone = F.lit(False) if refused is None else F.coalesce(refused, F.lit(False))
    return frame.where(~gone & ~future & (F.coalesce(exempt, F.lit(False)) | recent))


def unexpired(frame: DataFrame, expires: str, now: Column, longer: Column, ttl_hours: float) -> DataFrame:
    """Cache rows before their end; where `longer` holds, a row can still be revalidated for one more lifetime."""
    end = F.when(longer, F.col(expires) + hours(ttl_hours)).otherwise(F.col(expires))
    return frame.where(end > now)


def cache_rows(frame: DataFrame, keys: Sequence[str], now: Column, failed: Column, ttl_hours: float = 14 * 24, failed_hours: float = 24) -> DataFrame:
    """A row per alias key of each row, with its `expires_at`: failures end sooner."""
    aliases = F.array_distinct(F.array_compact(F.array(*(F.nullif(F.col(k), F.lit("")) for k in keys))))
    life = F.when(failed, now + hours(failed_hours)).otherwise(now + hours(ttl_hours))
    return frame.withColumn("expires_at", life).withColumn("cache_key", F.explode(aliases))


def lookup(frame: DataFrame, cache: DataFrame, keys: Sequence[str], identity: str, checked: str) -> DataFrame:
    """(identity, hit): of each row the newest cache entry under any of its keys, the first key's on ties."""
    aliases = frame.select(F.col(identity).alias("identity"), F.posexplode(F.array(*keys)).alias("place", "cache_key")).where("cache_key <> ''")
    entry = F.struct(*(F.col(c) for c in cache.columns))
    met = aliases.join(cache.withColumn("entry", entry), "cache_key")
    order = F.struct(F.col(f"entry.{checked}").alias("at"), (-F.col("place")).alias("place"))
    return met.groupBy("identity").agg(F.max_by("entry", order).alias("hit")).withColumnRenamed("identity", identity)


def backfill(candidates: DataFrame, done: Sequence[tuple[DataFrame, Sequence[str]]], newest: Column, tie: str, most: int) -> DataFrame:
    """The newest `most` candidates that none of the `done` tables has, each by its own columns."""
    for table, keys in done:
        candidates = candidates.join(table.select(*keys).distinct(), list(keys), "left_anti")
    return candidates.orderBy(newest.desc_nulls_last(), F.col(tie)).limit(most)


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change): keys that were added, removed or changed between two versions.

    Rows are compared by a hash of all other columns, so only keys and hashes are shuffled.
    """
    columns = sorted(set(new.columns) - {key})

    def digest(frame: DataFrame, name: str) -> DataFrame:
        return frame.select(key, F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns)).alias(name))

    both = digest(old, "was").join(digest(new, "now"), key, "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return both.select(key, change.alias("change")).where("change IS NOT NULL")


def only_allowed_changed(old: DataFrame, new: DataFrame, key: str, allowed: Sequence[str]) -> DataFrame:
    """Keys whose protected columns differ between two versions; empty where only `allowed` ones do."""
    return changes(old.drop(*allowed), new.drop(*allowed), key)


def table_fingerprint(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(rows, fingerprint): a digest of a table that the order of rows doesn't change.

    Row hashes are summed in 128 bits, so no list of rows is gathered.
    """
    h = F.xxhash64(*columns).cast("decimal(38,0)")
    return frame.agg(F.count("*").alias("rows"), F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)")).cast("string").alias("fingerprint"))


def frozen(state: DataFrame, live: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, changed, lost): the first filled value wins for good; whether the live one differs or is gone."""
    both = state.select(key, F.nullif(F.col(value), F.lit("")).alias("was")).join(live.select(key, F.nullif(F.col(value), F.lit("")).alias("now")), key, "full_outer")
    return both.select(
        key,
        F.coalesce("was", "now").alias(value),
        F.coalesce(F.col("was") != F.col("now"), F.lit(False)).alias("changed"),
        (F.col("was").isNotNull() & F.col("now").isNull()).alias("lost"),
    )


def fresh_or_previous(fresh: DataFrame, previous: DataFrame, status: DataFrame, source: str) -> DataFrame:
    """Fresh rows of sources that could be read, previous rows of the others. `status` has source and ok."""
    ok = status.where("ok").select(source)
    return fresh.join(ok, source, "left_semi").unionByName(previous.join(ok, source, "left_anti"))
