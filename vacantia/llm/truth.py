"""Best value of each field of a duplicate group, by iterative truth discovery.

Method: every source makes at most one claim per group and field (its latest). Votes for
a value are weighed by the reliability of its sources, the best-supported value is
chosen, and a source's reliability is estimated anew from how often its claims were
chosen, until no choice changes. A declared trust rank is the prior of a source's weight:
each rank weighs ``BASE`` times the number of sources less than the one before it, so the
estimates decide among sources of one rank (or without a rank), and any number of
worse-ranked votes does not outweigh a better-ranked one. There is one rule for ranked and
unranked sources, and both go through the same rounds.

The rounds run on patterns: what a group's claims look like is its sources in order of
their claims and which of them agree. Groups of one pattern vote alike, so a round handles
each distinct pattern once with its number of groups; the claims are moved once to bring a
group's claims together (one a source, whatever the number of rows) and once to give each
group its pattern's choice.

Defined cases: a null value is no claim; a null or unknown source has no rank and votes
with the rest; a group without a claim for a field has a null id for it. Ties go to the
latest claim, then to the smallest id. Repeated rows are one claim. A null group is left
out. Choices that do not settle within ``max_rounds`` are an error. Empty tables give
empty results. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut

UNRANKED = 2**31 - 1
#: A vote is worth at least LEAST of a full one; a rank more weighs BASE times the number of sources less.
LEAST = 0.0025
BASE = 1024.0
#: A broadcast of the source table is used up to this many sources, checked by count.
MAX_BROADCAST_SOURCES = 50_000


def gather(claims: DataFrame, fields: list[str]) -> DataFrame:
    """(grp, first_id, last_id, <field>: array<struct<at, neg, rank, source, value>>), newest first.

    claims: grp, source, id, at, rank (int, null without one) and a column per field. The
    first step keeps a source's latest claim of each field and combines before the
    shuffle, so a group of any number of rows is reduced to one row a source.
    """
    c = (
        claims.where(F.col("grp").isNotNull())
        .withColumn("rank", F.coalesce("rank", F.lit(UNRANKED)))
        .withColumn("at", F.coalesce(F.unix_micros(F.col("at").cast("timestamp")), F.lit(-(2**62))))
        .withColumn("source", F.coalesce("source", F.lit("")))
        .withColumn("neg", -F.col("id"))
    )
    latest = c.groupBy("grp", "source").agg(
        F.min("id").alias("a"), F.max("id").alias("z"), F.min("rank").alias("rank"),
        *[F.max_by(F.struct("at", "neg", F.col(f).alias("value")), F.when(F.col(f).isNotNull(), F.struct("at", "neg"))).alias(f) for f in fields],
    )
    one = lambda f: F.struct(f"{f}.at", f"{f}.neg", "rank", "source", f"{f}.value")
    return latest.groupBy("grp").agg(
        F.min("a").alias("first_id"), F.max("z").alias("last_id"),
        *[F.sort_array(F.collect_list(F.when(F.col(f).isNotNull(), one(f))), asc=False).alias(f) for f in fields],
    )


def _pattern(c: Column) -> Column:
    """array<struct<source, rank, value no>>: the claims of a field without their values."""
    values = F.array_distinct(F.transform(c, lambda x: x["value"]))
    return F.transform(c, lambda x: F.struct(x["source"].alias("source"), x["rank"].alias("rank"), F.array_position(values, x["value"]).cast("int").alias("v")))


def _choices(votes: DataFrame) -> DataFrame:
    """(p, v): the best supported value of each pattern; votes: p, v, depth, vote, at."""
    support = votes.groupBy("p", "v").agg(F.round(F.sum("vote"), 12).alias("s"), F.min("at").alias("at"))
    return support.groupBy("p").agg(F.max_by("v", F.struct("s", (-F.col("at")).alias("at"))).alias("v"))


def discover(groups: DataFrame, fields: list[str], max_rounds: int = 50) -> tuple[DataFrame, DataFrame]:
    """(truths, sources): (grp, first_id, last_id, <field>_id, <field>) and (source, reliability, n).

    groups: as ``gather`` gives them. ``<field>_id`` is the claim of the chosen value by
    its best-ranked source, then the latest, then the smallest id.
    """
    groups = cut(groups.withColumns({f"{f}_p": F.xxhash64(F.lit(f), _pattern(F.col(f))) for f in fields}))
    patterns = groups.select(F.explode(F.array(*[
        F.struct(F.col(f"{f}_p").alias("p"), _pattern(F.col(f)).alias("c")) for f in fields
    ])).alias("x")).select("x.*").where(F.size("c") > 0)
    # One row a claim of a pattern; ``depth`` is how far its rank is behind the pattern's best.
    each = cut(
        patterns.groupBy("p").agg(F.count("*").alias("groups"), F.first("c").alias("c"))
        .select("p", "groups", F.array_min(F.transform("c", lambda x: x["rank"])).alias("top"), F.posexplode("c").alias("at", "c"))
        .select("p", "groups", "at", "c.source", "c.v", (F.col("c.rank") - F.col("top")).alias("depth"))
    )
    sources = each.groupBy("source").agg(F.sum("groups").alias("n"), F.lit(0.0).alias("hits"), F.lit(1.0).alias("w"))
    count = each.select("source").distinct().count()
    base = F.lit(BASE * max(count, 1))
    before = None
    for done in range(max_rounds):
        weights = sources.select("source", "w")
        voted = each.join(F.broadcast(weights) if count <= MAX_BROADCAST_SOURCES else weights, "source")
        # Far behind the best rank a vote is 0: it could decide nothing.
        chosen = cut(_choices(voted.select("p", "v", "at", (F.col("w") * F.pow(base, -F.col("depth").cast("double"))).alias("vote"))))
        now = chosen.agg(F.count("*"), F.sum(F.xxhash64("p", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
        agree = each.join(chosen.select("p", F.col("v").alias("best")), "p").groupBy("source").agg(
            F.sum("groups").alias("n"), F.sum(F.when(F.col("v") == F.col("best"), F.col("groups")).otherwise(0)).cast("double").alias("hit")
        )
        # The mean of the rounds so far keeps choices from swinging to and fro; its
        # smoothed share is a vote in log-odds, as in Bayesian voting.
        mean = (F.col("hits") * done + F.col("hit")) / (done + 1)
        p = (mean + 1.0) / (F.col("n") + 2.0)
        sources = cut(agree.join(sources.select("source", "hits"), "source").select(
            "source", "n", mean.alias("hits"), F.greatest(F.least((F.log(p / (1 - p)) + 1.0) / 20.0, F.lit(1.0)), F.lit(LEAST)).alias("w")
        ))
    else:
        raise RuntimeError("the choices did not settle; raise max_rounds")
    found = groups
    for f in fields:
        best = chosen.select(F.col("p").alias(f"{f}_p"), F.col("v").alias(f"{f}_v"))
        found = found.join(best, f"{f}_p", "left")
        values = F.array_distinct(F.transform(f, lambda x: x["value"]))
        value = F.when(F.col(f"{f}_v").isNotNull(), values[F.col(f"{f}_v") - 1])
        mine = F.filter(f, lambda x: x["value"] == F.col(f"{f}_value"))
        claim = F.array_max(F.transform(mine, lambda x: F.struct((-x["rank"]).alias("r"), x["at"].alias("at"), x["neg"].alias("neg"))))
        found = found.withColumn(f"{f}_value", value).withColumn(f"{f}_id", -claim["neg"])
    truths = found.select("grp", "first_id", "last_id", *[c for f in fields for c in (F.col(f"{f}_id"), F.col(f"{f}_value").alias(f))])
    return truths, sources.select("source", F.round("w", 6).alias("reliability"), "n")
