"""Joins of facts, features and dimensions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from priorframe.functions.names import last_token, normalize_name, team_tag
from priorframe.sources.work import materialize


def assemble(spine: DataFrame, features: list[DataFrame], keys: list[str]) -> DataFrame:
    """Left joins of feature tables, one row a key each, onto a spine."""
    return reduce(lambda left, right: left.join(right, keys, "left"), features, spine)


def opposing(df: DataFrame, episode: list[str], entity: str, columns: list[str]) -> DataFrame:
    """Each row with the columns of the other entities of its episode, as opp_*."""
    other = df.select(*episode, F.col(entity).alias(f"opp_{entity}"), *(F.col(c).alias(f"opp_{c}") for c in columns))
    return df.join(other, episode).filter(F.col(entity) != F.col(f"opp_{entity}"))


def is_member(df: DataFrame, members: DataFrame, keys: list[str], name: str) -> DataFrame:
    """A flag: whether the keys are among members."""
    known = members.select(*keys).distinct().withColumn(name, F.lit(True))
    return df.join(known, keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def slot_weighted(rows: DataFrame, keys: list[str], order: list[str], rates: DataFrame, member: str, rate: str, weights: list[float], least: int) -> DataFrame:
    """Weighted mean rate of the first rows of each group, one weight a slot; null below least known rates."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    first = rows.withColumn("slot", place).filter(F.col("slot") <= len(weights)).join(rates.select(member, rate), member, "left")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("slot"))
    known = F.when(F.col(rate).isNotNull(), weight)
    return first.groupBy(*keys).agg(F.when(F.count(rate) >= least, F.sum(F.col(rate) * weight) / F.sum(known)).alias(rate), F.count(rate).alias("known"))


def frozen_baseline(df: DataFrame, train: Column, keys: list[str], hit: str, name: str) -> DataFrame:
    """df with the rate of hit by keys in the training rows alone."""
    base = df.filter(train).groupBy(*keys).agg(F.avg(hit).alias(name))
    return df.join(base, keys, "left")


def split_overlap(train: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: how many of its values are in both sets."""
    parts = []
    for k in keys:
        both = train.select(k).distinct().join(test.select(k).distinct(), k, "left_semi")
        parts.append(both.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("key"), "n"))
    return reduce(DataFrame.unionByName, parts)


def require_no_overlap(train: DataFrame, test: DataFrame, keys: list[str]) -> None:
    shared = [r["key"] for r in split_overlap(train, test, keys).collect() if r["n"]]
    if shared:
        raise ValueError(f"train and test share values of {', '.join(shared)}")


def split_faults(train: DataFrame, test: DataFrame, epoch: str, keys: list[str], day: str, first_epoch: int) -> DataFrame:
    """Rows (check, n) of what is wrong with a split: epochs, keys and days on both sides, and training epochs before the first that is allowed."""
    both = lambda name, columns: train.select(*columns).distinct().join(test.select(*columns).distinct(), columns, "left_semi").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")
    early = train.filter(F.col(epoch) < first_epoch).select(epoch).distinct().agg(F.count(F.lit(1)).alias("n")).select(F.lit("early_epochs").alias("check"), "n")
    return reduce(DataFrame.unionByName, [both("epochs", [epoch]), both("keys", keys), both("days", [day]), early])


def require_clean_split(train: DataFrame, test: DataFrame, epoch: str, keys: list[str], day: str, first_epoch: int) -> None:
    """Refuse to train where split_faults finds any."""
    found = {r["check"]: r["n"] for r in split_faults(train, test, epoch, keys, day, first_epoch).collect() if r["n"]}
    if found:
        raise ValueError(f"refusing to train: {', '.join(f'{n} {c}' for c, n in sorted(found.items()))}")


def match_names(props: DataFrame, roster: DataFrame, prop: str, prop_key: str, name: str, entity: str, team: str) -> DataFrame:
    """Entity of each prop by full name, else by last token; several candidates are settled by the team tag or refused.

    Columns: the prop's key, entity (null if none), reason. Candidates are counted once for
    each name and team, so a prop meets at most two rows, however many entities share its name.
    Names are normalized once and written: inlined in join keys and filters they would be made again for each.
    """
    p = props.select(prop_key, prop).repartition(prop_key).select(prop_key, normalize_name(prop).alias("_full"), team_tag(prop).alias("_tag"))
    p = materialize(p.withColumn("_last", last_token(F.col("_full"))), "props")
    r = roster.select(F.col(entity).alias("_entity"), normalize_name(name).alias("_rname"), F.upper(F.col(team)).alias("_team")).filter("_rname <> ''").distinct()
    r = materialize(r.withColumn("_rlast", last_token(F.col("_rname"))), "roster")

    def resolve(rows: DataFrame, by: str, known: str, how: str) -> DataFrame:
        teams = r.groupBy(F.col(known).alias(by), F.col("_team").alias("_tag")).agg(F.count("_entity").alias("_n"), F.max("_entity").alias("_e"))
        # The name alone, and the name with the tag where a candidate is on that team.
        names = teams.groupBy(by).agg(F.sum("_n").alias("_all_n"), F.max("_e").alias("_all_e"))
        met = rows.join(names, by).join(teams, [by, "_tag"], "left")
        found = met.groupBy(prop_key).agg(F.max(F.col("_n").isNotNull()).alias("_on"), F.sum("_n").alias("_n"), F.max("_e").alias("_e"), F.sum("_all_n").alias("_all_n"), F.max("_all_e").alias("_all_e"))
        n, one = F.when(F.col("_on"), F.col("_n")).otherwise(F.col("_all_n")), F.when(F.col("_on"), F.col("_e")).otherwise(F.col("_all_e"))
        return found.select(prop_key, F.when(n == 1, one).alias("entity"), F.when(n == 1, how).otherwise("ambiguous").alias("reason"))

    full = resolve(p, "_full", "_rname", "full_name")
    rest = p.join(full, prop_key, "left_anti")
    last = resolve(rest, "_last", "_rlast", "last_name")
    found = full.unionByName(last)
    return props.select(prop_key).join(found, prop_key, "left").withColumn("reason", F.coalesce("reason", F.lit("no_match")))
