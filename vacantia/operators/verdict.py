"""Whether a reader's languages suffice for an advert, from what it states about languages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from .evidence import NAMES

# English names of the languages, levels of a verdict from worst to best.
LANGUAGES = {
    "en": "English", "da": "Danish", "sv": "Swedish", "no": "Norwegian", "de": "German", "nl": "Dutch", "fi": "Finnish", "fr": "French", "it": "Italian", "es": "Spanish",
    "pt": "Portuguese", "pl": "Polish",
}
LEVELS = ("blocked", "likely", "plus", "unknown", "ok")
# End of fixed values.


def codes(values: list[str] | None) -> frozenset[str]:
    """Codes of languages given as a code, an English or a native name, in any case; others are left out."""
    known = {c: c for c in LANGUAGES} | {n.lower(): c for c, n in LANGUAGES.items()} | {n: c for c, ns in NAMES.items() for n in ns}
    return frozenset(known[v] for v in (str(x).strip().lower() for x in values or ()) if v in known)


@dataclass(frozen=True)
class Profile:
    """Languages somebody works in, and those they get by in."""

    fluent: frozenset[str] = frozenset({"en", "fr", "it", "es"})
    basic: frozenset[str] = frozenset({"da"})

    @classmethod
    def from_config(cls, config: dict | None) -> "Profile":
        """From ``languages: {fluent, basic}``; without the section the default, without fluent ones English."""
        section = (config or {}).get("languages")
        if not section:
            return cls()
        fluent = codes(section.get("fluent"))
        return cls(fluent or frozenset({"en"}), codes(section.get("basic")) - fluent)


def _set(values: frozenset[str]) -> Column:
    return F.array(*[F.lit(v) for v in sorted(values)]).cast("array<string>")


def _name(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, code), code)


def _names(found: Column) -> Column:
    return F.array_join(F.transform(found, _name), " + ")


def verdict(profile: Profile) -> Column:
    """struct(level, label, reason, languages, stated) over ad_language, required, preferred, waived, english_workplace.

    A stated requirement blocks, an advert in another language makes trouble likely unless
    it says otherwise, a wished-for language is a plus; a statement that the reader's
    languages suffice is better evidence than the language of the text.
    """
    lang, none = F.col("ad_language"), F.array().cast("array<string>")
    foreign = lambda c: F.array_sort(F.array_except(F.col(c), _set(profile.fluent)))
    missing, soft, free = foreign("required"), foreign("preferred"), foreign("waived")
    known = F.array_intersect(missing, _set(profile.basic))
    note = F.when(F.size(known) > 0, F.concat(F.lit(" (you have basic "), _names(known), F.lit(")"))).otherwise("")
    basic = F.when(F.array_contains(_set(profile.basic), lang), F.lit(" (you have basic)")).otherwise("")
    excused = F.col("english_workplace") | F.array_contains("waived", lang) | F.array_contains("preferred", lang)
    shown = F.coalesce(lang, F.try_element_at(F.array_sort("required"), F.lit(1)))

    def made(level: str, label: Column, reason: Column, languages: Column, stated: bool = False) -> Column:
        return F.struct(F.lit(level).alias("level"), label.alias("label"), reason.alias("reason"), languages.alias("languages"), F.lit(stated).alias("stated"))

    return (
        F.when(F.size(missing) > 0, made("blocked", F.concat(F.lit("Needs "), _names(missing)), F.concat(F.lit("ad requires "), _names(missing), note), missing))
        .when(
            lang.isNotNull() & ~F.array_contains(_set(profile.fluent), lang) & ~excused,
            made("likely", F.concat(F.lit("Ad in "), _name(lang)), F.concat(F.lit("ad is written in "), _name(lang), basic), F.array(lang)),
        )
        .when(F.size(soft) > 0, made("plus", F.concat(_names(soft), F.lit(" a plus")), F.concat(_names(soft), F.lit(" is a plus")), soft))
        .when(F.col("english_workplace"), made("ok", F.lit("English workplace"), F.lit("working language is English"), F.array(F.lit("en")), True))
        .when(F.size(free) > 0, made("ok", F.concat(F.lit("No "), _names(free), F.lit(" needed")), F.concat(F.lit("ad says "), _names(free), F.lit(" is not required")), free, True))
        .when(shown.isNotNull(), made("ok", _name(shown), F.concat(F.lit("ad is in "), _name(shown)), F.array(shown)))
        .otherwise(made("unknown", F.lit("?"), F.lit("no language information in the ad"), none))
    )
