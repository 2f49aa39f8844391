"""Reports of a ranked list, as lines (a table), as text, and as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .rank import TIERS, history_line, order_columns

# Headings of the tiers.
HEADINGS = {"viable": "Worth applying", "long shot": "Long shots", "unviable": "Probably not viable"}
# End of fixed values.


def line() -> Column:
    """'score  company: title  [location]' with the score right-aligned, as a terminal shows it."""
    where = F.when(F.col("location") != "", F.concat(F.lit("  ["), F.col("location"), F.lit("]"))).otherwise(F.lit(""))
    return F.concat(F.lit("  "), F.lpad(F.col("score").cast("string"), 3, " "), F.lit("  "), F.col("company"), F.lit(": "), F.col("title"), where)


def markdown_line() -> Column:
    where = F.when(F.col("location") != "", F.concat(F.lit(" - "), F.col("location"))).otherwise(F.lit(""))
    posted = F.when(F.col("posted").isNotNull(), F.concat(F.lit(" _(posted "), F.col("posted").cast("string"), F.lit(")_"))).otherwise(F.lit(""))
    return F.concat(
        F.lit("- **"), F.col("score").cast("string"), F.lit("** · **"), F.col("company"), F.lit("**: ["), F.col("title"), F.lit("]("), F.col("url"), F.lit(")"), where, posted,
        F.lit(" `"), F.col("source"), F.lit("`"),
    )


def details(similar: Column | None = None) -> Column:
    """array of the lines under a vacancy: language, other boards and history; reasons; possible duplicates."""
    others = F.filter("sources", lambda s: s != F.col("source"))
    facts = F.concat_ws(
        " · ", F.concat(F.lit("language: "), F.col("verdict.label")), F.when(F.size(others) > 0, F.concat(F.lit("also on: "), F.array_join(others, ", "))),
        F.nullif(history_line(F.col("prior")), F.lit("")),
    )
    parts = [facts, F.when(F.size("reasons") > 0, F.array_join("reasons", "; "))]
    if similar is not None:
        parts.append(F.when(F.size(similar) > 0, F.concat(F.lit("possible duplicate of: "), F.array_join(similar, "; "))))
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def tier_summary(ranked: DataFrame) -> DataFrame:
    """(tier, vacancies, listings) of the tiers that occur."""
    return ranked.groupBy("tier").agg(F.count("*").alias("vacancies"), F.sum("listings").cast("bigint").alias("listings"))


def summary(ranked: DataFrame) -> DataFrame:
    """One row: vacancies, listings, sources and a count per tier (``viable``, ``long_shot``, ``unviable``)."""
    tiers = [F.count(F.when(F.col("tier") == t, 1)).alias(t.replace(" ", "_")) for t in TIERS]
    base = ranked.agg(F.count("*").alias("vacancies"), F.coalesce(F.sum("listings"), F.lit(0)).cast("bigint").alias("listings"), *tiers)
    return base.crossJoin(ranked.select(F.explode("sources").alias("s")).agg(F.count_distinct("s").alias("sources")))


def labels(pairs: DataFrame, vacs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(vacancy_key, similar): 'company: title' of the possible duplicates of the wanted vacancies.

    pairs: (a, b) as ``entity.similar_pairs`` gives them. Only the vacancies a report shows
    are gathered, so a vacancy with very many alike costs nothing unless it is shown.
    """
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    named = both.join(wanted.select(F.col("vacancy_key").alias("a")), "a", "left_semi").join(
        vacs.select(F.col("vacancy_key").alias("b"), F.concat("company", F.lit(": "), "title").alias("label")), "b"
    )
    return named.groupBy(F.col("a").alias("vacancy_key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "label"))), lambda x: x["label"]).alias("similar"))


def shown(ranked: DataFrame, pairs: DataFrame | None, most: int | None) -> DataFrame:
    """The best ``most`` vacancies (all without a number) with the labels of their possible duplicates."""
    best = ranked if most is None else ranked.orderBy(*order_columns()).limit(most)
    if pairs is None:
        return best.withColumn("similar", F.array().cast("array<string>"))
    return best.join(labels(pairs, ranked, best), "vacancy_key", "left").withColumn("similar", F.coalesce("similar", F.array().cast("array<string>")))


def _collected(ranked: DataFrame, pairs: DataFrame | None, most: int, first: Column) -> tuple[dict, list]:
    """The one place rows reach the driver: at most ``most`` of them."""
    rows = shown(ranked, pairs, most).orderBy(*order_columns()).select("tier", "url", first.alias("line"), details(F.col("similar")).alias("details")).collect()
    return summary(ranked).first().asDict(), rows


def _more(total: int, rows: list) -> list[str]:
    return [f"... and {total - len(rows)} more", ""] if total > len(rows) else []


def render_markdown(ranked: DataFrame, day: str, pairs: DataFrame | None = None, most: int = 200) -> str:
    """A Markdown digest by tier, best first. Beyond ``most`` vacancies it says how many are left out."""
    n, rows = _collected(ranked, pairs, most, markdown_line())
    out = [f"# New jobs: {day}", ""]
    if not n["vacancies"]:
        return "\n".join([*out, "No new postings since the last run.", ""])
    counts = ", ".join(f"{n[t.replace(' ', '_')]} {t}" for t in TIERS)
    out += [f"**{n['vacancies']} new** vacancies ({n['listings']} listing(s) across {n['sources']} source(s)): {counts}.", ""]
    for tier in TIERS:
        mine = [r for r in rows if r["tier"] == tier]
        if mine:
            out += [f"## {HEADINGS[tier]} ({n[tier.replace(' ', '_')]})", ""]
            for r in mine:
                out += [r["line"], *[f"  - {x}" for x in r["details"]]]
            out.append("")
    return "\n".join(out + _more(n["vacancies"], rows))


def render_console(ranked: DataFrame, day: str, pairs: DataFrame | None = None, most: int = 200) -> str:
    """The digest as plain text."""
    n, rows = _collected(ranked, pairs, most, line())
    if not n["vacancies"]:
        return f"[{day}] No new postings."
    rule = "=" * 46
    out = [f"[{day}] {n['vacancies']} new vacancy(ies)", rule]
    for tier in TIERS:
        mine = [r for r in rows if r["tier"] == tier]
        if mine:
            out += [f"\n{HEADINGS[tier].upper()} ({n[tier.replace(' ', '_')]})", rule.replace("=", "-")]
            for r in mine:
                out += [r["line"], f"       {r['url']}", *[f"       {x}" for x in r["details"]]]
    return "\n".join(out + _more(n["vacancies"], rows))


def report_table(ranked: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(tier, place, vacancy_key, line, details): the whole report as a table, without a limit.

    ``place`` counts within tier and score, so no tier is sorted in one task.
    """
    w = W.partitionBy("tier", "score").orderBy(F.lower("company"), F.lower("title"), "url", "vacancy_key")
    return shown(ranked, pairs, None).select(
        "tier", "score", F.row_number().over(w).alias("place"), "vacancy_key", markdown_line().alias("line"), F.array_join(details(F.col("similar")), "\n").alias("details")
    )


def write_report(ranked: DataFrame, folder: str, day: str, pairs: DataFrame | None = None) -> str | None:
    """Writes the report of a day as sorted text files in ``folder``/``day``; None when there is nothing new."""
    if ranked.isEmpty():
        return None
    rows = shown(ranked, pairs, None).orderBy(*order_columns())
    path = f"{folder.rstrip('/')}/{day}"
    rows.select(F.array_join(F.concat(F.array(markdown_line()), F.transform(details(F.col("similar")), lambda x: F.concat(F.lit("  - "), x))), "\n")).write.mode("overwrite").text(path)
    return path
