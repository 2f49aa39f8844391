"""Explainable scores of vacancies from configured words, places and dates."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import word_in
from .verdict import Profile, verdict

# Scale of the score and its tiers, and the defaults of the rules.
BASE, VIABLE_AT, LONG_SHOT_AT = 50, 55, 30
TIERS = ("viable", "long shot", "unviable")
BOOST = {"playwright": 10, "pytest": 5, "python": 5}
PENALISE = {"senior": 10, "lead": 10, "principal": 20, "staff": 15, "head of": 25, "director": 25, "manager": 20, "architect": 15}
REMOTE_REGIONS = (
    "worldwide", "anywhere", "global", "europe", "european", "emea", "eu", "denmark", "sweden", "nordic", "nordics",
    "scandinavia", "france", "italy", "spain", "cet", "cest", "gmt", "utc",
)
LANGUAGE_POINTS = {"blocked": -60, "likely": -35, "plus": -5}
ACTED = {
    "applied": "you applied to", "rejected": "you were rejected from", "interview": "you are interviewing for", "offer": "you have an offer from",
}
# End of fixed values.


@dataclass(frozen=True)
class Settings:
    keywords: tuple[str, ...] = ()
    boost: dict[str, int] = field(default_factory=lambda: dict(BOOST))
    penalise: dict[str, int] = field(default_factory=lambda: dict(PENALISE))
    avoid: dict[str, int] = field(default_factory=dict)
    remote_regions: tuple[str, ...] = REMOTE_REGIONS
    stale_after_days: int = 45
    profile: Profile = field(default_factory=Profile)

    @classmethod
    def from_config(cls, config: dict | None, keywords: list[str] | None = None) -> "Settings":
        """From a mapping; a plain list of words gives each 10 points, a missing one the defaults."""
        config = config or {}
        section = config.get("ranking") or {}

        def weights(name: str, default: dict[str, int]) -> dict[str, int]:
            v = section.get(name)
            if v is None:
                return dict(default)
            return {str(k).lower(): int(v[k]) if isinstance(v, dict) else 10 for k in v}

        words = config.get("keywords", []) if keywords is None else keywords
        return cls(
            tuple(k for k in words if str(k).strip()), weights("boost", BOOST), weights("penalise", PENALISE), weights("avoid", {}),
            tuple(str(r).lower() for r in section.get("remote_regions", REMOTE_REGIONS)), int(section.get("stale_after_days", 45)),
            Profile.from_config(config),
        )


def _part(points: Column, reason: Column) -> Column:
    return F.struct(points.cast("int").alias("points"), reason.alias("reason"))


def _listed(hits: list[tuple[str, Column]]) -> Column:
    return F.array_join(F.filter(F.array(*[F.when(h, F.lit(f"'{w}'")) for w, h in hits]), lambda x: x.isNotNull()), ", ")


def keyword_points(title: Column, tags: Column, keywords: tuple[str, ...]) -> Column:
    """+15 and 5 more for each further keyword in the title (25 at most); -10 if only in tags."""
    if not keywords:
        return _part(F.lit(0), F.lit(None).cast("string"))
    words = sorted(set(keywords), key=str.lower)
    low, tag = F.lower(title), F.array_join(tags, " ")
    hits = [(w, F.contains(low, F.lit(w.strip().lower()))) for w in words]
    n = sum((F.when(h, 1).otherwise(0) for _, h in hits), F.lit(0))
    points = F.least(F.lit(15) + 5 * (n - 1), F.lit(25))
    in_tags = F.lit(False)
    for w in words:
        in_tags = in_tags | F.contains(tag, F.lit(w.strip().lower()))
    return (
        F.when(n > 0, _part(points, F.concat(F.lit("+"), points.cast("string"), F.lit(" "), _listed(hits), F.lit(" in title"))))
        .when(in_tags, _part(F.lit(-10), F.lit("-10 keyword only in tags, not the title")))
        .otherwise(_part(F.lit(0), F.lit(None).cast("string")))
    )


def word_points(text: Column, weights: dict[str, int], cap: int, sign: int, pattern: str) -> Column:
    """Summed weights of the whole words found, capped; the reason names the words."""
    if not weights:
        return _part(F.lit(0), F.lit(None).cast("string"))
    hits = [(w, word_in(text, w)) for w in sorted(weights)]
    total = F.least(sum((F.when(h, weights[w]).otherwise(0) for w, h in hits), F.lit(0)), F.lit(cap))
    words = _listed(hits)
    reason = F.concat(F.lit("+" if sign > 0 else "-"), total.cast("string"), F.lit(" "), F.replace(F.lit(pattern), F.lit("{}"), words))
    return F.when(total > 0, _part(total * sign, reason)).otherwise(_part(F.lit(0), F.lit(None).cast("string")))


def remote_points(location: Column, regions: tuple[str, ...]) -> Column:
    """-25 for 'Remote (x)' when x names none of the regions."""
    t = F.trim(location)
    limit = F.regexp_extract(t, r"(?i)^remote \((.*)\)$", 1)
    open_to = F.lit(False)
    for r in regions:
        open_to = open_to | word_in(F.lower(limit), r)
    shut = t.rlike(r"(?i)^remote \(.*\)$") & ~open_to
    return F.when(shut, _part(F.lit(-25), F.concat(F.lit("-25 remote only for "), limit))).otherwise(_part(F.lit(0), F.lit(None).cast("string")))


def stale_points(posted: Column, today: Column, after_days: int) -> Column:
    age = F.datediff(today, posted)
    old = (age > after_days) & F.lit(after_days > 0)
    return F.when(old, _part(F.lit(-10), F.concat(F.lit("-10 posted "), age.cast("string"), F.lit(" days ago")))).otherwise(_part(F.lit(0), F.lit(None).cast("string")))


def language_points(v: Column, profile: Profile) -> Column:
    """Points of a language verdict: -60, -35, -5 (-10 for a language one has nothing of), +5 when stated."""
    none = F.array(*[F.lit(c) for c in sorted(profile.basic)]).cast("array<string>")
    level = v["level"]
    points = (
        F.when((level == "plus") & (F.size(F.array_except(v["languages"], none)) > 0), -10).when((level == "ok") & v["stated"], 5)
        .when(level == "blocked", LANGUAGE_POINTS["blocked"]).when(level == "likely", LANGUAGE_POINTS["likely"]).when(level == "plus", LANGUAGE_POINTS["plus"]).otherwise(0)
    )
    said = F.concat(F.when(points > 0, F.lit("+")).otherwise(""), points.cast("string"), F.lit(" "), v["reason"])
    return _part(points, F.when(points != 0, said))


def history_points(prior: Column) -> Column:
    """-50 for a vacancy acted on, -30 for a skipped one; prior: struct(status, title, when, exact) or null."""
    status, day = prior["status"], F.concat(F.lit(" ("), prior["when"].cast("string"), F.lit(")"))
    what = F.when(prior["exact"], F.lit("this vacancy")).otherwise(F.concat(F.lit('a similar one ("'), prior["title"], F.lit('")')))
    phrase = F.lit(None).cast("string")
    for name, words in ACTED.items():
        phrase = F.when(status == name, F.lit(words)).otherwise(phrase)
    return (
        F.when(status.isin(*ACTED), _part(F.lit(-50), F.concat(F.lit("-50 "), phrase, F.lit(" "), what, day)))
        .when(status == "skipped", _part(F.lit(-30), F.concat(F.lit("-30 you skipped "), what, day))).otherwise(_part(F.lit(0), F.lit(None).cast("string")))
    )


def history_line(prior: Column) -> Column:
    """What is already known of a vacancy, '' for nothing."""
    what = F.when(prior["exact"], F.lit("this")).otherwise(F.concat(F.lit('similar "'), prior["title"], F.lit('"')))
    return (
        F.when(prior.isNull(), "").when(prior["status"] == "new", F.concat(what, F.lit(" first seen "), prior["first_seen"].cast("string")))
        .otherwise(F.concat(what, F.lit(": "), prior["status"], F.lit(" "), prior["when"].cast("string")))
    )


def score(vacs: DataFrame, settings: Settings, today: Column) -> DataFrame:
    """Adds verdict, score (0..100), tier and reasons.

    vacs: title, tags, text, location, posted, the columns of ``evidence.read_evidence``
    and prior (struct(status, title, when, first_seen, exact), null without one). The caps
    come after the score: a stated requirement one cannot meet or a vacancy acted on is
    unviable, an advert in another language at most a long shot.
    """
    staged = vacs.withColumns({"verdict": verdict(settings.profile), "__low": F.lower("text"), "__head": F.lower("title")})
    parts = F.array(
        keyword_points(F.col("title"), F.col("tags"), settings.keywords),
        word_points(F.col("__low"), settings.boost, 20, 1, "mentions {}"),
        word_points(F.col("__head"), settings.penalise, 40, -1, "{} in title"),
        word_points(F.col("__low"), settings.avoid, 40, -1, "mentions {}"),
        language_points(F.col("verdict"), settings.profile),
        remote_points(F.col("location"), settings.remote_regions),
        history_points(F.col("prior")),
        stale_points(F.col("posted"), today, settings.stale_after_days),
    )
    scored = staged.withColumn("__p", parts).withColumn(
        "score", F.greatest(F.lit(0), F.least(F.lit(100), F.aggregate("__p", F.lit(BASE), lambda a, x: a + x["points"])))
    )
    acted = F.coalesce(F.col("prior.status").isin(*ACTED), F.lit(False))
    level = F.col("verdict.level")
    tier = (
        F.when((level == "blocked") | acted, TIERS[2]).when((F.col("score") >= VIABLE_AT) & (level != "likely"), TIERS[0])
        .when(F.col("score") >= LONG_SHOT_AT, TIERS[1]).otherwise(TIERS[2])
    )
    return scored.withColumn("tier", tier).withColumn(
        "reasons", F.filter(F.transform("__p", lambda x: x["reason"]), lambda r: r.isNotNull())
    ).drop("__p", "__low", "__head")


def order_columns() -> list[Column]:
    """The total order of a ranked list: tier, score, company, title, URL."""
    tier = F.when(F.col("tier") == TIERS[0], 0).when(F.col("tier") == TIERS[1], 1).otherwise(2)
    return [tier.asc(), F.desc("score"), F.lower("company").asc(), F.lower("title").asc(), F.col("url").asc()]
