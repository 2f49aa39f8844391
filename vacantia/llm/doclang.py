"""Language of each text and of each segment of a mixed one, with a confidence.

Method: Bayesian evidence fusion. Every line gets a likelihood per language from its
words: function words, and further words learnt from all texts. What else speaks
for a language is the prior of the text: its declared language (which may be wrong), the
language its markup declares, the suffix of its address, and a prior of its host, which is
smoothed towards its domain's, that towards its suffix's and that towards the prior of
all; these priors come from grouped aggregation of the declared languages. The text's
share of each language is then estimated from its lines, with its prior in place of
``PRIOR_LINES`` lines; share times likelihood is the posterior of a line, and the
posterior decides: a line is in a language when that leads by ``MARGIN``, by the words
alone or by a single telling word that the evidence agrees with. A label that the
other lines contradict counts for little; in a text of few telling words it decides.
Neighbouring lines of one language form a segment, whose confidence is the posterior of
all its lines together.

A line without a telling word is in no language and belongs to the segment before it
(lines before the first segment belong to none).

Defined cases: null, blank and wordless texts have no segments; markup and entities are
ignored but keep their place in a line; texts are read whole; a tie between languages
goes to the first in ``LANGUAGES``; a text without a declared language, with an unusable
one or with a null address gets the prior of all hosts; repeated label rows count once
(the least label); empty tables give empty results. Only the named columns are read.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.skew import skew_join

LANGUAGES = ("en", "da", "sv", "de", "nl", "fr", "it", "es", "pt")

# Function words by language, names and codes of languages, address suffixes.
WORDS = {
    "en": "the a an and or of to in on at for with from by is are was were be been being have has had do does did not no but if as this that these those it its you your "
    "we our us they their them he she his her i my me who what which when where how why all any each every more most other some such only own same so than too very can will "
    "would could should may might must about into through during before after above below up down out off over under again then once here there because while until both few "
    "between against also just like there's don't we're you'll least used people would looking",
    "da": "og i jeg det at en den til er som på de med han af for ikke der var mig sig men et har om vi min havde ham hun nu over da fra du ud sin dem os op man hans hvor eller "
    "hvad skal selv her alle vil blev kunne ind når være dog noget ville jo deres efter ned skulle denne end dette mit også under have dig anden hende mine alt meget sit sine vor "
    "mod disse hvis din nogle hos blive mange ad bliver hendes været thi jer sådan vores fra dine dit hjælper søger mindst lignende stilling gerne",
    "sv": "och det att i en jag hon som han på den med var sig för så till är men ett om hade de av icke mig du henne då sin nu har inte hans honom skulle hennes där min man ej vid "
    "kunde något från ut när efter upp vi dem vara vad över än dig kan sina här ha mot alla under någon eller allt mycket sedan ju denna själv detta åt utan varit hur ingen mitt ni "
    "bli blev oss din dessa några deras blir mina samma vilken er sådan vår blivit dess inom mellan vilket varför varje vilka ditt vem vart dina vars vårt våra ert era söker minst också",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über "
    "einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei ich du wir ihr mich mir dich dir uns euch ihn ihm ihre ihren ihrem ihrer seine unser unsere unseren "
    "kein keine wenn weil denn doch schon sehr hier dort dann was wer wo diese dieser dieses jede jeder alle können müssen sollen ohne gegen unter zwischen während damit ihnen selbst",
    "nl": "de het een en van ik te dat die in is niet zijn op aan met als voor er maar om dan zou of wat mijn men dit zo door over ze zich bij ook tot je mij uit der daar haar naar "
    "heb hoe heeft hebben deze u want nog zal me zij nu ge geen omdat iets worden toch al waren veel meer doen toen moet ben zonder kan hun dus alles onder ja werd wezen zelf tegen "
    "komen goed hier wie waarom wij ons onze jouw jullie werken wanneer elkaar graag bied bieden zoeken minimaal",
    "fr": "le la les un une des du de et en à au aux que qui ne pas par pour dans sur avec ce cette ces il elle ils elles je tu nous vous on mon ma mes ton ta tes son sa ses notre nos "
    "votre vos leur leurs se plus mais ou où donc or ni car est sont été être avoir ai as avons avez ont était sera si sans sous entre chez vers depuis très aussi même tout tous toute "
    "toutes comme quand dont quel quelle lui eux c'est n'est d'un d'une jusqu'à l'on qu'il chaque pendant après avant",
    "it": "il lo la i gli le un uno una di a da in con su per tra fra e ed o ma se che chi cui non più come dove quando perché anche io tu lui lei noi voi loro mi ti si ci vi mio mia tuo "
    "tua suo sua nostro nostra vostro vostra questo questa quello quella sono è sei siamo siete era essere ho hai ha abbiamo hanno avere del dello della dei degli delle al allo alla ai "
    "agli alle dal dalla dai dalle nel nello nella nei nelle sul sulla sui sulle ogni tutto tutti dopo prima senza sempre molto già nostri nostre quel un'altra dall'inizio alla fino ruolo",
    "es": "el la los las un una unos unas de del a al en con por para sin sobre entre y e o u pero si no que quien cual cuando donde como porque más muy también yo tú él ella nosotros "
    "vosotros ellos ellas me te se nos os le les lo mi mis tu tus su sus nuestro nuestra nuestros nuestras este esta estos estas ese esa eso es son era fue ser estar está están he has ha "
    "hemos han haber hay desde hasta cada todo toda todos todas ya así según durante aunque somos gran así quiera dos tres días año años hoy siempre nunca puede pueden",
    "pt": "o a os as um uma uns umas de do da dos das em no na nos nas por pelo pela pelos pelas para com sem sobre entre e ou mas se não que quem qual quando onde como porque mais muito "
    "também eu tu ele ela nós vós eles elas você vocês me te lhe lhes meu minha teu tua seu sua seus suas nosso nossa nossos nossas este esta estes estas esse essa isso é são era foi ser "
    "estar está estão tem têm ter temos há desde até cada todo toda todos todas já ao aos à às num numa uma connosco pessoa função anos vai menos pelo mim consigo",
}
NAMES = {
    "en": "en eng english engelsk engelska englisch engels anglais inglese ingles inglês inglés",
    "da": "da dan danish dansk danska dänisch deens danois danese danes dinamarquês danés",
    "sv": "sv swe swedish svensk svenska schwedisch zweeds suédois svedese sueco",
    "de": "de deu ger german tysk tyska deutsch duits allemand tedesco alemán alemão",
    "nl": "nl nld dut dutch hollandsk nederländska niederländisch nederlands flemish néerlandais olandese neerlandés holandés holandês",
    "fr": "fr fra fre french fransk franska französisch frans français francais francese francés francês",
    "it": "it ita italian italiensk italienska italienisch italiaans italien italiano",
    "es": "es spa spanish spansk spanska spanisch spaans espagnol spagnolo español espanol castellano espanhol",
    "pt": "pt por portuguese portugisisk portugisiska portugiesisch portugees portugais portoghese portugués português portugues",
}
SUFFIX = {"dk": "da", "se": "sv", "de": "de", "at": "de", "nl": "nl", "fr": "fr", "it": "it", "es": "es", "pt": "pt", "br": "pt", "uk": "en", "us": "en", "ie": "en"}
# End of fixed values.

#: Share of declared labels taken to be right, of languages declared in markup, and of addresses whose suffix fits.
DECLARED_RIGHT = 0.8
MARKUP_RIGHT = 0.8
SUFFIX_RIGHT = 0.5
#: Weight of a wider prior in a narrower one (all, suffix, domain, host), in texts.
HOST_SMOOTHING = 20.0
#: Lines the prior of a text stands for, beside those of the text.
PRIOR_LINES = 1.0
#: Words the word model keeps, at most; times a word must be seen.
VOCABULARY = 30_000
SEEN = 5
#: Lead of the best language, in nats: of the words to count for the fit, of the posterior to be a language at all.
SURE = 6.0
MARGIN = 2.5
#: A function word of other languages only is this unlikely in a language.
LEAK = 0.02
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_TAG = re.compile(r"<(?:[/?]?[A-Za-z]|!)[^<>\n]*>")
_MARKUP = re.compile(r"""<[A-Za-z][^<>]*?\b(?:xml:)?lang\s*=\s*["']?([A-Za-z]{2,3})""")


class WordModel:
    """log P(word | language) against the mean of all languages, by word."""

    def __init__(self, words: list[str], matrix: np.ndarray):
        self.at = {w: i for i, w in enumerate(words)}
        self.matrix = matrix

    def hits(self, text: str | None) -> Iterator[tuple[int, list[int]]]:
        """(line number, places of its known words) of the lines that have any."""
        at = self.at
        for n, line in enumerate((text or "").split("\n")):
            if "<" in line or "&" in line:
                line = html.unescape(_TAG.sub(" ", line))
            found = [at[w] for w in _TOKEN.findall(line.lower().replace("’", "'")) if w in at]
            if found:
                yield n, found


def seed_model() -> WordModel:
    """The model of the function words alone."""
    langs_of: dict[str, set[str]] = {}
    for lang, ws in WORDS.items():
        for w in ws.split():
            langs_of.setdefault(w, set()).add(lang)
    words = sorted(langs_of)
    p = np.array([[1.0 if x in langs_of[w] else LEAK for x in LANGUAGES] for w in words])
    return WordModel(words, np.log(p / p.mean(axis=1, keepdims=True)).astype(np.float32))


def fit(texts: DataFrame, key: str, text: str) -> WordModel:
    """A word model from all texts, labelled by their function words.

    Lines in which the function words leave no doubt (``SURE``) count for their language;
    words seen ``SEEN`` times or more, at most ``VOCABULARY`` of them, get smoothed
    likelihoods, which are added to those of the function words.
    """
    seed = seed_model()
    some = texts.where(F.col(text).isNotNull()).select(F.col(text).alias("t"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            lines, at, ends = [], [], [0]
            for t in df["t"]:
                own = t.split("\n")
                for n, found in seed.hits(t):
                    if len(found) >= 2:
                        lines.append(own[n])
                        at += found
                        ends.append(len(at))
            if not lines:
                continue
            ll = np.add.reduceat(seed.matrix[at], ends[:-1], axis=0)
            top = np.partition(ll, -2, axis=1)
            seen: dict[str, list[int]] = {}
            for n in np.nonzero(top[:, -1] - top[:, -2] >= SURE)[0]:
                lang = int(ll[n].argmax())
                for w in set(_TOKEN.findall(_TAG.sub(" ", lines[n]).lower().replace("’", "'"))):
                    if w not in seen:
                        seen[w] = [0] * len(LANGUAGES)
                    seen[w][lang] += 1
            if seen:
                yield pd.DataFrame({"w": list(seen), "c": list(seen.values())})

    sums = [F.sum(F.col("c")[i]).cast("double").alias(x) for i, x in enumerate(LANGUAGES)]
    rows = (
        some.mapInPandas(count, "w string, c array<bigint>").groupBy("w").agg(*sums)
        .withColumn("n", sum((F.col(x) for x in LANGUAGES[1:]), F.col(LANGUAGES[0])))
        .where(F.col("n") >= SEEN).orderBy(F.desc("n"), "w").limit(VOCABULARY).collect()  # at most VOCABULARY rows
    )
    base = {w: seed.matrix[i] for w, i in seed.at.items()}
    if rows:
        counts = np.array([[r[x] for x in LANGUAGES] for r in rows])
        p = (counts + 0.5) / (counts.sum(axis=0) + 0.5 * len(rows))
        p = np.maximum(p, LEAK * p.max(axis=1, keepdims=True))
        # Words of every language (names, tools) are flattened by the floor and the mean.
        learnt = np.log(p / p.mean(axis=1, keepdims=True))
        for r, ll in zip(rows, learnt):
            base[r["w"]] = (base[r["w"]] + ll) / 2 if r["w"] in base else ll / 2
    words = sorted(base)
    return WordModel(words, np.array([base[w] for w in words], dtype=np.float32))


def score_lines(texts: DataFrame, key: str, text: str, model: WordModel) -> DataFrame:
    """(k, markup, line_no array<int>, words array<int>, ll array<float>): the lines with telling words.

    ``ll`` holds the log likelihoods of all languages line after line, ``words`` the number
    of telling words, ``markup`` the language the markup declares first.
    """
    todo = texts.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    kind = todo.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ends, nos, count, markup, keep = [], [], [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                before = len(nos)
                for n, found in model.hits(t):
                    at += found
                    nos.append(n)
                    count.append(len(found))
                if len(nos) > before:
                    keep.append(i)
                    ends.append(len(nos))
                    m = _MARKUP.search(t) if "lang" in t else None
                    markup.append(m.group(1).lower() if m else None)
            if not keep:
                continue
            starts = np.concatenate([[0], np.cumsum(count)[:-1]])
            ll = np.add.reduceat(model.matrix[at], starts, axis=0).astype(np.float32)
            offsets = np.concatenate([[0], ends]).astype(np.int32)
            lists = lambda values, width=1: pa.ListArray.from_arrays(pa.array(offsets * np.int32(width)), values)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep)), pa.array(markup, pa.string()), lists(pa.array(nos, pa.int32())), lists(pa.array(count, pa.int32())),
                 lists(pa.array(ll.ravel()), len(LANGUAGES))],
                ["k", "markup", "line_no", "words", "ll"],
            )

    return todo.mapInArrow(run, f"k {kind}, markup string, line_no array<int>, words array<int>, ll array<float>")


def language_code(label: Column) -> Column:
    """Code of a label in any usual form (en-GB, eng, English), null for no language."""
    pairs = [x for code, names in NAMES.items() for n in names.split() for x in (F.lit(n), F.lit(code))]
    word = F.regexp_extract(F.lower(F.trim(label)), r"^([\p{L}]+)(?:[-_ ].*)?$", 1)
    return F.try_element_at(F.create_map(*pairs), word)


def _vector(log_of: dict[str | None, list[float]], c: Column) -> Column:
    out = F.array(*[F.lit(float(x)) for x in log_of[None]])
    for k, v in log_of.items():
        if k is not None:
            out = F.when(c == k, F.array(*[F.lit(float(x)) for x in v])).otherwise(out)
    return out


def _agreeing(right: float) -> dict[str | None, list[float]]:
    even = (1.0 - right) / (len(LANGUAGES) - 1)
    out: dict[str | None, list[float]] = {None: [0.0] * len(LANGUAGES)}
    for a in LANGUAGES:
        out[a] = [math.log((right if a == b else even) * len(LANGUAGES)) for b in LANGUAGES]
    return out


def host_priors(meta: DataFrame) -> DataFrame:
    """(host, prior array<double>, n): log prior of each language by host.

    meta: host, declared. A host's shares are smoothed towards those of its domain (the
    last two labels), these towards its suffix's and these towards those of all.
    """
    counts = [F.count(F.when(F.col("declared") == x, 1)).cast("double").alias(x) for x in LANGUAGES]
    vector = lambda f: F.array(*[f(x) for x in LANGUAGES])
    by_host = meta.groupBy("host").agg(F.count("*").alias("n"), *counts).select(
        "host", "n", vector(F.col).alias("own"), F.regexp_extract("host", r"([^.]+\.)?[^.]+$", 0).alias("domain"), F.regexp_extract("host", r"[^.]+$", 0).alias("suffix")
    )
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    smooth = lambda own, wider: F.transform(
        F.arrays_zip(own.alias("o"), wider.alias("w")), lambda x: (x["o"] + HOST_SMOOTHING * x["w"]) / (total(own) + HOST_SMOOTHING)
    )
    summed = vector(lambda x: F.coalesce(F.sum(F.col("own")[LANGUAGES.index(x)]), F.lit(0.0)))
    everywhere = by_host.agg(summed.alias("g")).select(F.transform("g", lambda x: (x + 1.0) / (total(F.col("g")) + len(LANGUAGES)))).scalar()
    by_suffix = by_host.groupBy("suffix").agg(summed.alias("own")).withColumn("g", everywhere).select("suffix", smooth(F.col("own"), F.col("g")).alias("of_suffix"))
    by_domain = by_host.groupBy("suffix", "domain").agg(summed.alias("own")).join(by_suffix, "suffix").select(
        "domain", smooth(F.col("own"), F.col("of_suffix")).alias("of_domain")
    )
    return by_host.join(by_domain, "domain").select("host", F.transform(smooth(F.col("own"), F.col("of_domain")), lambda x: F.log(x)).alias("prior"), "n")


def segments(
    texts: DataFrame, labels: DataFrame, key: str, text: str, url: str, label: str,
    model: WordModel | None = None, prior_weight: float = 1.0,
) -> DataFrame:
    """(key, line_no, lang, confidence, declared, mixed): one row per segment.

    ``declared`` is the code of the text's label (null without a usable one), ``mixed``
    whether the text has segments in more than one language. ``prior_weight`` scales the
    evidence beside the words; 0 leaves the words alone.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][\w+.\-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    declared = labels.select(F.col(key).alias("k"), language_code(F.col(label)).alias("declared")).groupBy("k").agg(F.min("declared").alias("declared"))
    meta = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), host.alias("host")).join(declared, "k", "left")
    placed = skew_join(meta, host_priors(meta), ["host"], "n", F.col("k"))
    suffix = F.regexp_extract("host", r"\.([a-z]{2})$", 1)
    suffix_lang = F.try_element_at(F.create_map(*[F.lit(x) for kv in SUFFIX.items() for x in kv]), suffix)
    stated = F.zip_with(
        F.zip_with(_vector(_agreeing(DECLARED_RIGHT), F.col("declared")), _vector(_agreeing(SUFFIX_RIGHT), suffix_lang), lambda a, b: a + b), "prior", lambda a, b: a + b
    )
    evidence = placed.select("k", "declared", stated.alias("stated"))
    markup = _vector(_agreeing(MARKUP_RIGHT), language_code(F.col("markup")))
    fused = score_lines(texts, key, text, model or fit(texts, key, text)).join(evidence, "k").select(
        "k", "declared", "line_no", "words", "ll",
        F.when(F.col("markup").isNull(), F.col("stated")).otherwise(F.zip_with("stated", markup, lambda a, b: a + b)).alias("extra"),
    )
    kind = fused.schema["k"].dataType.simpleString()
    wide = len(LANGUAGES)

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(LANGUAGES, dtype=object)
        for batch in batches:
            if not batch.num_rows:
                continue
            k, said, line_no, words, ll, extra = (batch.column(n) for n in ("k", "declared", "line_no", "words", "ll", "extra"))
            of = np.repeat(np.arange(batch.num_rows), line_no.value_lengths().to_numpy())
            line_no, words = line_no.flatten().to_numpy(), words.flatten().to_numpy()
            ll = ll.flatten().to_numpy().reshape(-1, wide).astype(np.float64)
            prior = prior_weight * extra.flatten().to_numpy().reshape(-1, wide)
            # Shares of the languages in a text: its telling lines, and its prior as PRIOR_LINES more.
            share = PRIOR_LINES * _softmax(prior)
            telling = words >= 2
            np.add.at(share, of[telling], _softmax(ll[telling]))
            share /= share.sum(axis=1, keepdims=True)
            posterior = ll + np.log(share)[of]
            lang = posterior.argmax(axis=1)
            top = np.partition(posterior, -2, axis=1)
            ok = (top[:, -1] - top[:, -2] >= MARGIN) & (ll[np.arange(len(ll)), lang] > 0)
            of, line_no, lang, ll = of[ok], line_no[ok], lang[ok], ll[ok]
            if not len(of):
                continue
            # A line opens a segment when the line before it is of another text or language.
            first = np.ones(len(of), dtype=bool)
            first[1:] = (of[1:] != of[:-1]) | (lang[1:] != lang[:-1])
            at = np.nonzero(first)[0]
            total = np.add.reduceat(ll, at, axis=0) + prior[of[at]]
            sure = _softmax(total)[np.arange(len(at)), lang[at]]
            mixed = np.bincount(of[at], minlength=batch.num_rows)[of[at]] > 1
            rows = pa.array(of[at])
            yield pa.RecordBatch.from_arrays(
                [k.take(rows), pa.array(line_no[at], pa.int32()), pa.array(names[lang[at]], pa.string()), pa.array(np.round(sure, 4), pa.float64()), said.take(rows), pa.array(mixed)],
                ["k", "line_no", "lang", "confidence", "declared", "mixed"],
            )

    return fused.mapInArrow(fuse, f"k {kind}, line_no int, lang string, confidence double, declared string, mixed boolean").withColumnRenamed("k", key)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)
