"""What an advert states about languages: required, preferred or waived, clause by clause.

Everything is a Column expression. A clause's language names and cue phrases are located
as (position, kind) arrays; each name takes the kind of its nearest cue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .lang import detect, english_workplace

# Names of languages in the languages adverts are written in, what may follow them, cue phrases.
NAMES: dict[str, tuple[str, ...]] = {
    "en": ("english", "engelsk", "engelska", "englisch", "anglais", "inglese", "inglés", "ingles", "inglês"),
    "da": ("danish", "dansk", "danska", "dänisch", "danois", "danese", "danés"),
    "sv": ("swedish", "svensk", "svenska", "schwedisch", "suédois", "svedese", "sueco"),
    "no": ("norwegian", "norsk", "norska", "norwegisch", "norvégien", "norvegese", "noruego"),
    "de": ("german", "tysk", "tyska", "deutsch", "allemand", "tedesco", "alemán"),
    "nl": ("dutch", "hollandsk", "nederlandsk", "nederländska", "niederländisch", "nederlands", "néerlandais"),
    "fi": ("finnish", "finsk", "finska", "finnisch", "finnois", "suomi"),
    "fr": ("french", "fransk", "franska", "französisch", "français", "francais", "francese", "francés"),
    "it": ("italian", "italiensk", "italienska", "italienisch", "italien", "italiano"),
    "es": ("spanish", "spansk", "spanska", "spanisch", "espagnol", "spagnolo", "español", "espanol"),
    "pt": ("portuguese", "portugisisk", "portugisiska", "portugiesisch", "portugais", "portoghese", "portugués"),
    "pl": ("polish", "polsk", "polska", "polnisch", "polonais", "polacco"),
}
COMPOUNDS = {"dansk": "da", "svensk": "sv", "norsk": "no", "tysk": "de", "engelsk": "en", "fransk": "fr"}
COMPOUND_ENDS = "kundskaber|kunskaper|kompetencer|kompetens|talende|talande|sproget|sprogede|språkig"
FOLLOWERS = (
    "is are and or as at in on would will language languages skills skill proficiency fluency speaker speakers speaking spoken written required mandatory preferred plus "
    "knowledge level both a an to native fluently communication verbal with but also be og er i på eller samt som sprog kundskaber både flydende skriftligt mundtligt kan vil "
    "ville och är språk kunskaper tal flytande und oder ist sprachkenntnisse kenntnisse fließend et ou est courant obligatoire e o y es è fluente fluido requis exigé richiesto requerido"
).split()
WAIVE = (
    r"not\s+(?:a\s+)?(?:requirement|required|necessary|needed|mandatory|essential|a\s+must)|\bno\s+[\p{L}\p{Nl}\p{No}]+\s+(?:is\s+)?(?:required|needed|necessary)"
    r"|no\s+need|(?:don't|do\s+not|doesn't|does\s+not|won't|will\s+not)\s+(?:need|require|have\s+to)|without\s+(?:speaking|knowing)?|isn't\s+(?:required|necessary|needed)"
    r"|ikke\s+(?:et\s+)?(?:krav|nødvendigt|påkrævet|nødvendig)|kræver\s+ikke|behøver\s+(?:du\s+)?ikke|uden\s+at|inte\s+(?:ett\s+)?(?:krav|nödvändigt|nödvändig)|inget\s+krav"
    r"|krävs\s+inte|behöver\s+(?:du\s+)?inte|nicht\s+(?:erforderlich|notwendig|nötig|zwingend)|keine\s+voraussetzung|pas\s+(?:obligatoire|nécessaire|requis)"
    r"|non\s+(?:richiesto|necessario|obbligatorio)|no\s+(?:es\s+)?(?:necesario|obligatorio|imprescindible|requerido)"
)
SOFT = (
    r"\bplus\b|\bbonus\b|advantage|advantageous|nice[\s-]to[\s-]have|preferred|preferabl[ey]|desirable|\basset\b|beneficial|\bmerit\b|ideally|appreciated"
    r"|would\s+be\s+(?:great|good|nice)|fordel|ønskeligt|ønskværdigt|meriterende|meriterande|fördel|önskvärt|von\s+vorteil|vorteilhaft|wünschenswert|un\s+atout|souhaité|souhaitable"
    r"|apprécié|gradit[ao]|preferibile|valorará|valorable|deseable|se\s+valora"
)
STRONG = (
    r"fluen(?:t|cy|tly)|native|mother\s+tongue|proficien(?:t|cy)|required|requirement|mandatory|\bmust\b|essential|necessary|need\s+to|needs\s+to|business[\s-]level"
    r"|professional\s+working|\bc1\b|\bc2\b|bilingual|flydende|modersmål|påkrævet|\bkrav\b|kræver|skal\s+kunne|perfekt|fejlfrit|flytande|krävs|kräver|obligatorisk|fließend"
    r"|fliessend|verhandlungssicher|muttersprach|voraussetzung|erforderlich|zwingend|courant|maîtrise|natif|obligatoire|exigé|requis|madrelingua|richiest[oa]|obbligatori[oa]"
    r"|imprescindible|requerido|obligatorio|nativo|dominio"
)
WEAK = (
    r"\bspeak|\bspoken\b|\bwrite\b|\bwritten\b|\bexcellent\b|\bstrong\b|\bgood\b|command\s+of|skills\s+in|communicat|\btaler\b|\bskriver\b|behersker|skrift\s+og\s+tale"
    r"|tale\s+og\s+skrift|mundtlig|skriftlig|\bgode?\b|stærke|\btalar\b|behärskar|tal\s+och\s+skrift|goda?\s+kunskaper|mycket\s+god|\bgute?\b|sehr\s+gute|kenntnisse"
    r"|wort\s+und\s+schrift|\bparle[rz]?\b|\bécrit|\boral\b|bonne\s+maîtrise|\bparli\b|\bhabla"
)
CLAUSE = r"[.!?;\n•·|]+|\s[-–]\s"
# End of fixed values.

_CODE = {n: c for c, ns in NAMES.items() for n in ns}
_ALL = "|".join(sorted(_CODE, key=len, reverse=True))
# A name counts when a mark follows it, nothing follows, or one of the words that speak of a language.
_MENTION = (
    rf"(?U)(?<![\w-])(?:{_ALL})(?!\w)(?=\s*[,:/()&]|\s*[-–]?\s*(?:{'|'.join(sorted(set(FOLLOWERS), key=len, reverse=True))})(?![\p{{L}}\p{{Nl}}\p{{No}}])"
    r"|\s*[-–]?\s*(?![\p{L}\p{Nl}\p{No}\s–-])|\s*[-–]?\s*$)"
)
_COMPOUND = rf"(?U)\b(?:{'|'.join(COMPOUNDS)})(?:{COMPOUND_ENDS})\b"


def _positions(clause: Column, pattern: str) -> Column:
    """array<struct<start, text>> of a pattern's matches."""
    found = F.regexp_extract_all(clause, F.lit(pattern), F.lit(0))
    parts = F.split(clause, pattern, -1)
    pairs = F.zip_with(F.slice(parts, 1, F.size(found)), found, lambda a, b: F.named_struct(F.lit("gap"), F.length(a), F.lit("text"), b))
    none = F.array().cast("array<struct<start:int,text:string>>")
    start = F.named_struct(F.lit("at"), F.lit(0), F.lit("out"), none)

    def step(acc: Column, x: Column) -> Column:
        here = (acc.getField("at") + x.getField("gap")).cast("int")
        hit = F.named_struct(F.lit("start"), here, F.lit("text"), x.getField("text"))
        after = (here + F.length(x.getField("text"))).cast("int")
        return F.named_struct(F.lit("at"), after, F.lit("out"), F.concat(acc.getField("out"), F.array(hit)))

    return F.aggregate(pairs, start, step, lambda acc: acc.getField("out"))


def _blank(clause: Column, pattern: str) -> Column:
    """The clause with every match replaced by as many spaces."""
    found = F.regexp_extract_all(clause, F.lit(pattern), F.lit(0))
    parts = F.split(clause, pattern, -1)
    filled = F.zip_with(F.slice(parts, 1, F.size(found)), found, lambda a, b: F.concat(a, F.repeat(F.lit(" "), F.length(b))))
    return F.concat(F.array_join(filled, ""), F.element_at(parts, -1))


def _cues(clause: Column, pattern: str, kind: int) -> Column:
    return F.transform(_positions(clause, pattern), lambda m: F.named_struct(F.lit("at"), F.floor((m["start"] * 2 + F.length(m["text"])) / 2).cast("int"), F.lit("kind"), F.lit(kind)))


def read_evidence(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ad_language, required, preferred, waived, english_workplace), lists sorted."""
    base = df.select(key, F.coalesce(F.col(text), F.lit("")).alias("__ad"))
    clauses = base.select(key, F.explode(F.split(F.lower("__ad"), CLAUSE)).alias("c")).where(F.col("c").rlike(_MENTION) | F.col("c").rlike(_COMPOUND))
    p = {k: "(?U)" + v for k, v in (("waive", WAIVE), ("soft", SOFT), ("strong", STRONG), ("weak", WEAK))}
    staged = clauses.withColumn("m1", _blank(F.col("c"), p["waive"])).withColumn("m2", _blank(F.col("m1"), p["soft"]))
    codes = F.create_map(*[F.lit(x) for n, c in _CODE.items() for x in (n, c)])
    heads = F.create_map(*[F.lit(x) for n, c in COMPOUNDS.items() for x in (n, c)])
    named = F.transform(_positions(F.col("c"), _MENTION), lambda m: F.named_struct(F.lit("at"), m["start"], F.lit("code"), codes[m["text"]]))
    joined = F.transform(
        _positions(F.col("c"), _COMPOUND),
        lambda m: F.named_struct(F.lit("at"), m["start"], F.lit("code"), heads[F.regexp_extract(m["text"], "^(" + "|".join(COMPOUNDS) + ")", 1)]),
    )
    cued = staged.select(
        key, F.explode(F.concat(named, joined)).alias("m"),
        F.concat(_cues(F.col("c"), p["waive"], 0), _cues(F.col("m1"), p["soft"], 1), _cues(F.col("m2"), p["strong"], 2)).alias("cues"),
        F.col("m2").rlike(p["weak"]).alias("weak"), F.xxhash64("c").alias("clause"),
    )
    nearest = F.array_min(F.transform("cues", lambda q: F.named_struct(F.lit("d"), F.abs(q["at"] - F.col("m.at")), F.lit("kind"), q["kind"])))["kind"]
    verdict = F.when(F.size("cues") > 0, nearest).when(F.col("weak"), F.lit(2))
    # In one clause the stronger statement holds: waived, then required, then preferred.
    strength = F.when(F.col("v") == 0, 2).when(F.col("v") == 2, 1).otherwise(0)
    per_clause = cued.select(key, "clause", F.col("m.code").alias("code"), verdict.alias("v")).where("v IS NOT NULL").groupBy(key, "clause", "code").agg(F.max(strength).alias("s"))
    sets = per_clause.groupBy(key).agg(*[F.array_sort(F.collect_set(F.when(F.col("s") == s, F.col("code")))).alias(n) for n, s in (("w", 2), ("r", 1), ("p", 0))])
    none = F.array().cast("array<string>")
    out = detect(base, "__ad", "ad_language").withColumn("english_workplace", english_workplace(F.col("__ad"))).drop("__ad").join(sets, key, "left")
    w, r, q = (F.coalesce(F.col(c), none) for c in ("w", "r", "p"))
    required = F.array_except(r, w)
    return out.select(
        key, "ad_language", required.alias("required"), F.array_except(F.array_except(q, w), required).alias("preferred"), w.alias("waived"), "english_workplace"
    )
