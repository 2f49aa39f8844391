"""The seen-set and its status history, as append-only tables with derived views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .entity import first_per_fingerprint, similar_pairs

# The statuses, in their order.
STATUSES = ("new", "applied", "rejected", "interview", "offer", "skipped")
# End of fixed values.


def new_listings(listings: DataFrame, seen: DataFrame, order: str = "ord") -> DataFrame:
    """The first listing of each fingerprint that the seen-set does not hold."""
    return first_per_fingerprint(listings, order).join(seen.select("fingerprint"), "fingerprint", "left_anti")


def newest_first(seen: DataFrame) -> DataFrame:
    """All rows, the last seen first."""
    return seen.orderBy(F.desc("first_seen"), "record_id")


def mark_seen(listings: DataFrame, seen: DataFrame, now: str, order: str = "ord") -> DataFrame:
    """The rows to append: new listings with first_seen, and the status their vacancy already has.

    Replaying the same listings appends nothing, so first_seen never moves. The inherited
    status comes with its date and note; a vacancy nobody acted on is 'new'.
    """
    fresh = new_listings(listings, seen, order).drop("status", "status_at", "note")
    acted = seen.where((F.col("status") != "new") & (F.col("vacancy_key") != "")).groupBy("vacancy_key").agg(
        F.max_by(F.struct("status", "status_at", "note"), _acted_order()).alias("s")
    )
    return fresh.join(acted, "vacancy_key", "left").select(
        *[F.col(c) for c in fresh.columns], F.lit(now).cast("timestamp_ntz").alias("first_seen"), F.coalesce("s.status", F.lit("new")).alias("status"),
        F.col("s.status_at").alias("status_at"), F.coalesce("s.note", F.lit("")).alias("note"),
    )


def _acted_order() -> Column:
    """Of several statuses of a vacancy the latest holds, then the later seen, then the higher fingerprint and id."""
    return F.struct(F.coalesce("status_at", F.lit("0001-01-01").cast("date")).alias("a"), "first_seen", "fingerprint", "record_id")


def rekey(seen: DataFrame, key: Column, company: Column) -> DataFrame:
    """The table with its keys computed anew and disagreeing statuses settled.

    Missing tracker columns of an older table are added first (status 'new', no date, no
    note). A vacancy whose listings disagree takes the status set last on any of them,
    with its date and note; 'new' is no such status.
    """
    for name, kind, default in (("status", "string", "new"), ("status_at", "date", None), ("note", "string", "")):
        if name not in seen.columns:
            seen = seen.withColumn(name, F.lit(default).cast(kind))
    keyed = seen.withColumns({"vacancy_key": key, "company_key": company})
    last = keyed.groupBy("vacancy_key").agg(
        F.count_distinct("status").alias("n"),
        F.max_by(F.struct("status", "status_at", "note"), F.when(F.col("status") != "new", _acted_order())).alias("s"),
    ).where("n > 1").select("vacancy_key", "s")
    settled = keyed.join(last, "vacancy_key", "left")
    pick = lambda c: F.when(F.col("s").isNotNull(), F.col(f"s.{c}")).otherwise(F.col(c)).alias(c)
    return settled.select(*[pick(c) if c in ("status", "status_at", "note") else F.col(c) for c in keyed.columns])


def current_status(seen: DataFrame) -> DataFrame:
    """(vacancy_key, status, status_at): a vacancy's latest status that is not 'new'.

    All listings of a vacancy share it; ties go to the later first_seen and the higher
    fingerprint. Rows without a vacancy key have no status of their own here.
    """
    acted = seen.where((F.col("status") != "new") & (F.col("vacancy_key") != ""))
    last = acted.groupBy("vacancy_key").agg(
        F.max_by(F.struct("status", "status_at"), _acted_order()).alias("s")
    )
    keys = seen.where("vacancy_key <> ''").select("vacancy_key").distinct()
    return keys.join(last, "vacancy_key", "left").select("vacancy_key", F.coalesce("s.status", F.lit("new")).alias("status"), F.col("s.status_at").alias("status_at"))


def status_counts(seen: DataFrame, since: str | None = None) -> DataFrame:
    """(status, vacancies) for every status, zero-filled; ``since`` keeps 'new' and later ones."""
    rows = seen.where("vacancy_key <> ''")
    if since:
        rows = rows.where((F.col("status") == "new") | (F.col("status_at") >= F.lit(since).cast("date")))
    counted = rows.groupBy("status").agg(F.count_distinct("vacancy_key").alias("n"))
    every = seen.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return every.join(counted, "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("bigint").alias("vacancies"))


def response_rate(counts: DataFrame) -> DataFrame:
    """(applied, answered, rate) of a status count; 0.0 without an application."""
    n = lambda names: F.coalesce(F.sum(F.when(F.col("status").isin(*names), F.col("vacancies"))), F.lit(0))
    sums = counts.agg(n(("applied", "rejected", "interview", "offer")).alias("applied"), n(("rejected", "interview", "offer")).alias("answered"))
    return sums.withColumn("rate", F.round(F.coalesce(F.try_divide(F.col("answered").cast("double"), F.col("applied").cast("double")), F.lit(0.0)), 6))


def by_status(seen: DataFrame, status: str) -> DataFrame:
    """(vacancy_key, record_id, title, company, first_seen, listings): the newest row of each vacancy."""
    rows = seen.where((F.col("status") == status) & (F.col("vacancy_key") != ""))
    return rows.groupBy("vacancy_key").agg(
        F.max_by(F.struct("record_id", "title", "company", "first_seen"), F.struct("first_seen", "record_id")).alias("r"), F.count("*").alias("listings")
    ).select("vacancy_key", "r.*", "listings")


def find(seen: DataFrame, needle: str) -> DataFrame:
    """Rows whose fingerprint, company, title or URL contains the needle, in any case, newest first.

    ``%`` and ``_`` in the needle stand for any characters and any one.
    """
    like = "%" + needle.replace("\\", "\\\\") + "%"
    hit = F.lit(False)
    for c in ("fingerprint", "company", "title", "url"):
        hit = hit | F.coalesce(F.col(c).ilike(like), F.lit(False))
    return newest_first(seen.where(hit))


def prune(seen: DataFrame, cutoff: str) -> DataFrame:
    """The rows that stay: all but 'new' ones first seen before the cutoff."""
    return seen.where(~((F.col("status") == "new") & (F.col("first_seen") < F.lit(cutoff).cast("timestamp_ntz"))))


def inherit_status(fresh: DataFrame, seen: DataFrame) -> DataFrame:
    """New rows with the status their vacancy already has."""
    return fresh.join(current_status(seen), "vacancy_key", "left").withColumn("status", F.coalesce("status", F.lit("new")))


def disagreeing(seen: DataFrame) -> DataFrame:
    """(vacancy_key, statuses): vacancies whose listings carry more than one status."""
    return seen.where("vacancy_key <> ''").groupBy("vacancy_key").agg(F.count_distinct("status").alias("statuses")).where("statuses > 1")


def priors(vacs: DataFrame, seen: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """(vacancy_key, prior_id, exact, status, title, when, first_seen): the most relevant row of the history.

    An exact key beats a similar title, an acted status beats 'new', then the later date,
    then the smaller record id. seen: vacancy_key, company_key, title_key, status,
    status_at, first_seen, record_id, and title (``own`` given: fingerprint). own:
    (vacancy_key, fingerprint) of the listings looked at; a 'new' row that is one of the
    vacancy's own listings is no history. The history is first reduced to one best row per
    key, so only distinct keys are compared; a fingerprint covers employer and title, so
    an own row has its vacancy's key.
    """
    when = F.coalesce("status_at", F.to_date("first_seen"))
    title = F.col("title") if "title" in seen.columns else F.lit(None).cast("string")
    row = F.struct("record_id", "status", title.alias("title"), when.alias("when"), F.to_date("first_seen").alias("first_seen"))
    order = F.struct((F.col("status") != "new").alias("a"), when.alias("w"), (-F.col("record_id")).alias("i"))
    if own is not None:
        mine = own.select("vacancy_key", "fingerprint", F.lit(True).alias("mine")).distinct()
        seen = seen.join(mine, ["vacancy_key", "fingerprint"], "left")
    else:
        seen = seen.withColumn("mine", F.lit(None).cast("boolean"))
    foreign = F.when((F.col("status") != "new") | F.col("mine").isNull(), order)
    best = seen.groupBy("vacancy_key").agg(
        F.max_by(row, order).alias("r"), F.max_by(row, foreign).alias("x"), F.min("company_key").alias("company_key"), F.min("title_key").alias("title_key")
    )
    exact = vacs.select("vacancy_key").join(best.select("vacancy_key", F.col("x").alias("r")).where("r IS NOT NULL"), "vacancy_key").select("vacancy_key", "r", F.lit(True).alias("exact"))
    alike = similar_pairs(vacs.select("vacancy_key", "company_key", "title_key"), best.select("vacancy_key", "company_key", "title_key"))
    other = alike.join(best.select(F.col("vacancy_key").alias("b"), "r"), "b").select(F.col("a").alias("vacancy_key"), "r", F.lit(False).alias("exact"))
    best_of = F.struct("exact", (F.col("r.status") != "new").alias("a"), F.col("r.when").alias("w"), (-F.col("r.record_id")).alias("i"))
    return exact.unionByName(other).groupBy("vacancy_key").agg(F.max_by(F.struct("r", "exact"), best_of).alias("p")).select(
        "vacancy_key", F.col("p.r.record_id").alias("prior_id"), F.col("p.exact").alias("exact"), *[F.col(f"p.r.{c}").alias(c) for c in ("status", "title", "when", "first_seen")]
    )


def set_status(events: DataFrame, seen: DataFrame, key: str, status: str, at: str, note: str = "") -> DataFrame:
    """The event to append when a vacancy's status is set; none for an unknown vacancy.

    events: vacancy_key, status, status_at, note, seq. A status belongs to the vacancy, so
    all its listings move together; an unknown status is an error.
    """
    if status not in STATUSES:
        raise ValueError(f"unknown status {status!r}")
    last = events.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("m")).scalar()
    return seen.where(F.col("vacancy_key") == key).select("vacancy_key").limit(1).select(
        "vacancy_key", F.lit(status).alias("status"), F.lit(at).cast("date").alias("status_at"), F.lit(note).alias("note"), (last + 1).cast("bigint").alias("seq")
    )


def folded_status(events: DataFrame, seen: DataFrame) -> DataFrame:
    """(vacancy_key, status, status_at, note): the last event of each vacancy, 'new' without one."""
    last = events.groupBy("vacancy_key").agg(F.max_by(F.struct("status", "status_at", "note"), "seq").alias("e"))
    return seen.select("vacancy_key").distinct().join(last, "vacancy_key", "left").select(
        "vacancy_key", F.coalesce("e.status", F.lit("new")).alias("status"), F.col("e.status_at").alias("status_at"), F.coalesce("e.note", F.lit("")).alias("note")
    )


def backdate(seen: DataFrame, fingerprint: str, day: str) -> DataFrame:
    """first_seen of one listing moved back to a day, never forward."""
    earlier = F.least("first_seen", F.lit(day).cast("timestamp_ntz"))
    return seen.withColumn("first_seen", F.when(F.col("fingerprint") == fingerprint, earlier).otherwise(F.col("first_seen")))


def mark(events: DataFrame, seen: DataFrame, needle: str, status: str, at: str, note: str = "") -> DataFrame | None:
    """The status event of the one vacancy a needle finds; None when it finds none or several."""
    key = single_vacancy(find(seen, needle))
    return None if key is None else set_status(events, seen, key, status, at, note)


def add(listing: DataFrame, seen: DataFrame, now: str, status: str = "applied", at: str | None = None, note: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows to append, the seen table as it then is, boards): a listing entered by hand.

    listing: one normalised row with identity and ord. It is appended if it is new, its
    whole vacancy takes the status, and with ``at`` its first_seen is no later than that
    day. boards: (source, listings) that already carry the vacancy.
    """
    if status not in STATUSES:
        raise ValueError(f"unknown status {status!r}")
    rows = mark_seen(listing, seen, now)
    boards = same_vacancy_elsewhere(listing, seen).groupBy("source").agg(F.count("*").alias("listings"))
    table = seen.unionByName(rows, allowMissingColumns=True)
    own = listing.select(F.col("vacancy_key").alias("__k"), F.col("fingerprint").alias("__f")).distinct()
    hit = (F.col("fingerprint") == F.col("__f")) | ((F.col("vacancy_key") == F.col("__k")) & (F.col("vacancy_key") != ""))
    day = F.lit(at or now).cast("date")
    moved = table.join(F.broadcast(own.limit(1)), hit, "left").withColumns({
        "status": F.when(F.col("__f").isNotNull(), F.lit(status)).otherwise(F.col("status")),
        "status_at": F.when(F.col("__f").isNotNull(), day).otherwise(F.col("status_at")),
        "note": F.when(F.col("__f").isNotNull(), F.lit(note)).otherwise(F.col("note")),
    })
    if at is not None:
        moved = moved.withColumn("first_seen", F.when(F.col("fingerprint") == F.col("__f"), F.least("first_seen", F.lit(at).cast("timestamp_ntz"))).otherwise(F.col("first_seen")))
    return rows, moved.drop("__k", "__f"), boards


def stats(seen: DataFrame, since: str | None = None) -> DataFrame:
    """(measure, value): the numbers of the tracker in one table, ready for a report."""
    counts = status_counts(seen, since)
    whole = seen.agg(F.count("*").alias("listings"), F.count_distinct("vacancy_key").alias("vacancies"))
    numbers = whole.select(F.explode(F.create_map(F.lit("listings"), F.col("listings").cast("double"), F.lit("vacancies"), F.col("vacancies").cast("double"))).alias("measure", "value"))
    rate = response_rate(counts).select(F.explode(F.create_map(
        F.lit("applications"), F.col("applied").cast("double"), F.lit("answers"), F.col("answered").cast("double"), F.lit("response rate"), F.col("rate")
    )).alias("measure", "value"))
    return numbers.unionByName(counts.select(F.col("status").alias("measure"), F.col("vacancies").cast("double").alias("value"))).unionByName(rate)


def single_vacancy(matches: DataFrame) -> str | None:
    """The vacancy key all matches share, None if they are of several or none (two rows reach the driver)."""
    keys = matches.select("vacancy_key").distinct().limit(2).collect()
    return keys[0][0] if len(keys) == 1 else None


def same_vacancy_elsewhere(listing: DataFrame, seen: DataFrame) -> DataFrame:
    """Seen rows of the same vacancy under another fingerprint."""
    k = listing.select("vacancy_key", F.col("fingerprint").alias("own")).distinct()
    return seen.join(k, "vacancy_key").where(F.col("fingerprint") != F.col("own")).drop("own")
