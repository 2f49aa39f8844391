"""Template residue, filler, error pages and script notices in documents.

Method: every line and sentence that could be such a message is masked (numbers,
addresses, dates and hex references become marks), the masked messages are grouped by
hash with their number of uses and sources, and each distinct message is classified once
by placeholder and phrase rules and by its recurrence. Messages are then joined back to
their documents.

The form of a message (a placeholder, a status code, a traceback, the fixed wording of a
notice) tells it at any number of copies. Other wording is told by recurrence: a message
whose shape (all numbers and fields blanked, case ignored) occurs ``USES`` times in
``SOURCES`` sources and that names a fault, the system at fault and what the reader is to
do about it is a ``notice``, listed or not.

Prose about placeholders or error pages is told from the messages themselves: a
placeholder inside a sentence that explains placeholders (words such as template,
variable, bracket) is no residue, and phrase rules ask for the wording of the message.

Defined cases: null, empty and blank texts hold nothing; texts are read whole; repeated
rows give the same answer and one result row; empty tables give empty results. Only the
named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.skew import skew_join
from ..session import cut

# Fields that templates fill, words of Latin filler, phrases of messages.
_FIELD = r"[\p{L}][\p{L}\p{N}]*(?:[ _.\-]?[\p{L}\p{N}]+){0,4}"
PLACEHOLDER = "|".join((
    rf"\{{\{{\s*{_FIELD}\s*\}}\}}",            # {{ name }}
    rf"[$#]\{{\s*{_FIELD}\s*\}}",              # ${name} #{name}
    rf"\{{%-?\s*{_FIELD}\s*-?%\}}",            # {% name %}
    rf"<%[=\-]?\s*{_FIELD}\s*-?%>",            # <%= name %>
    rf"\{{(?:\d+|{_FIELD})\}}",                # {0} {name}
    rf"\[\[\s*{_FIELD}\s*\]\]",                # [[name]]
    rf"<<\s*{_FIELD}\s*>>",                    # <<Name>>
    r"\*\|[A-Z_:]+\|\*",                       # *|NAME|*
    r"@@\s*[A-Za-z_]+\s*@@",                   # @@NAME@@
    r"%[A-Z][A-Z_]{2,}%|%%[A-Za-z_]+%%",       # %NAME%
    r"\$[A-Z][A-Z_]{2,}\$",                    # $NAME$
    r"(?<![\p{L}\p{N}_])__[A-Z][A-Z_]*[A-Z]__(?![\p{L}\p{N}_])",  # __NAME__
    r"(?<![\p{L}\p{N}_])[A-Z][A-Z_]*_PLACEHOLDER(?![\p{L}\p{N}_])",
    r"«\s?[A-Z]\p{L}+\s?»",                    # «MergeField»
    r"(?i:&lt;|<)(?!/)(?i:start date|job title|first name|last name|candidate name|contact email|salary range|office city|team size"
    r"|company|company name|city|date|deadline|department|benefits|location|manager|name|recruiter|salary|position|email|phone)(?i:&gt;|>)",
    r"(?i:&lt;[a-z]+(?:[ _][a-z]+)*&gt;)",
    rf"\[(?i:insert|your|indsæt|infoga|insérer|inserire|insertar|inserir|invoegen|enter|add|type|fill in)\s+{_FIELD}(?:\s+(?i:here|her|hier|ici))?\]",
    rf"\[{_FIELD}\s+(?i:einfügen|invullen|eintragen|here)\]",
    r"\[[A-Z]{4,}(?:[ _][A-Z]{2,})*\]",        # [COMPANY] [TEAM SIZE]
    rf"\({_FIELD} (?i:to be) (?i:inserted|added|confirmed|filled in|announced)\)",
    r"(?<![\p{L}\p{N}])[Xx]{4,}(?![\p{L}\p{N}])",
))
#: Words of a sentence that speaks about such marks, next to the mark it speaks of.
ABOUT = (
    r"(?i:\b(?:placeholders?|templates?|variables?|merge fields?|brackets?|such as|stays? as it is|are explained|in the text are fine"
    r"|code samples?|turns?)\b)"
)
EXPLAINED = rf"{ABOUT}.{{0,40}}?(?:{PLACEHOLDER})|(?:{PLACEHOLDER}).{{0,20}}?{ABOUT}"
_VOID = r"(?:undefined|null|\(null\)|NaN|None|#REF!|#N/A|#VALUE!|#NAME\?|\[object Object\]|Invalid Date|nil)"
EMPTY_VALUE = "(?i)" + "|".join((
    r"#REF!|#VALUE!|#NAME\?|\[object Object\]",
    rf"(?:^|[.!?] )(?:\p{{Lu}}[\p{{L}}/ ]{{1,24}}):\s*{_VOID}(?![\p{{L}}\p{{N}}])",
    rf"(?i:posted on|welcome to|hi|hej|hello|dear|bonjour|sehr geehrte/r|hallo|hola|ciao|olá|reply to|about|apply before|start date)\s+{_VOID}\s*[,.!]?(?:\s|$)",
    rf"(?<![\p{{L}}\p{{N}}]){_VOID}\s*(?:,|-|–|\()\s*{_VOID}(?![\p{{L}}\p{{N}}])",
    rf"^\s*{_VOID}\s*$",
    r"(?<![\p{L}\p{N}])(?:undefined|null|NaN|\(null\)|#N/A|Invalid Date)\s+(?:EUR|USD|GBP|DKK|SEK|people|employees|days)\b",
    r"(?<!\p{L})(?:Dear|Hi|Hej|Hello|Bonjour|Hallo|Sehr geehrte/r) ,(?:\s|$)",
    r"^\s*(?:Title|Location|Salary|Reports to|Deadline|Ansøgningsfrist|Start date)\s*:\s*(?:-|–|\||,|\(\))?\s*$",
    r"Salary:\s*(?:-|–)\s*EUR|\|\s*Ref:\s*$",
))
_LATIN = (
    "lorem|ipsum|dolor|sit|amet|consectetur|adipiscing|elit|sed|eiusmod|tempor|tempora|incididunt|labore|dolore|magna|aliqua|aliquet|enim|minim"
    "|veniam|quis|quisquam|nostrud|exercitation|ullamco|laboris|nisi|commodo|consequat|congue|duis|aute|irure|velit|esse|cillum|fugiat|nulla|pariatur"
    "|lacus|vesti|vestibulum|porta|portitor|porttitor|pharetum|pharetra|ultric|ultrici|ultrices|gravi|gravida|mollum|mollis|sodal|sodales|sedum|blandi|blandit"
    "|ferment|fermentum|erat|massa|nunc|ante|orci|augue|turpis|egestas|tellus|rutrum|viverra|vitae|justo|donec|etiam|mauris|proin|nullam|praesent"
)
_KEYS = "asdf|asdfg|asdfgh|asdfghjkl|qwer|qwert|qwerty|qwertyuiop|zxcv|zxcvb|zxcvbn|hjkl|jkl|jklö|uiop|yxcv"
FILLER = "|".join((
    rf"(?i)(?<!\p{{L}})(?:(?:{_LATIN})[\s,.]+){{3,}}(?:{_LATIN})(?!\p{{L}})",
    rf"(?i)(?<!\p{{L}})(?:(?:{_KEYS})\s+){{2,}}(?:{_KEYS})(?!\p{{L}})",
    r"(?i)(?<!\p{L})(\p{L}{2,}+)(?:[\s,.]++\1){3,}(?!\p{L})",
    r"(?i)(?<!\p{L})(\p{L}{2,}+\s++\p{L}{2,}+)(?:[\s,.]++\2){2,}(?!\p{L})",
    r"(?i)lorem ipsum dolor",
    r"(?i)(?:^|[.!?\-*•]\s+|\s)(?:Heading \d+|Paragraph text \d+|Bullet point (?:one|two|three|four|five|\d+))(?!\p{L})",
    r"(?i)\byour (?:content|text|copy) (?:goes )?here\b",
    r"(?i)\bsample text goes here\b|\bplaceholder (?:copy|text) (?:for|goes|to)\b|\bthis is (?:a )?(?:placeholder|dummy|sample) (?:copy|text)\b",
    r"(?i)\binsert (?:\p{L}+ ){0,4}(?:sentences?|text|copy|paragraphs?) (?:\p{L}+ ){0,4}here\b",
    r"(?i)\bcopy to follow\b|\bdescription coming soon\b|\breplace it before publishing\b|\bit will be replaced\b",
    r"(?i)\bblindtext dient nur\b|\bhier steht später ein text\b|\bher kommer der en tekst senere\b|\btexte provisoire, à remplacer\b",
    r"(?i)\bdette er en? (?:eksempeltekst|pladsholdertekst)\b|\bhär kommer en text\b|\btesto segnaposto\b|\btexto de (?:relleno|exemplo)\b",
))
_CODE = r"(?:4\d\d|5\d\d)"
ERROR_PAGE = "|".join((
    rf"(?i)(?<![\p{{L}}\p{{N}}]){_CODE}\s*[-–:]?\s*(?:Not Found|Forbidden|Unauthorized|Bad Request|Bad Gateway|Gateway Time-?out|Service Unavailable|Internal Server Error|Too Many Requests|Gone)",
    rf"(?i)\b(?:HTTP Status|HTTP Error|Error code|Fejlkode|Felkod|Fehlercode|Erreur|Fehler|Código de error|Errore)\s*:?\s*{_CODE}\b",
    r"(?i)\btype:\s*status report\b|\bmessage:\s*(?:forbidden|unauthorized|not found|bad gateway|bad request|too many requests|service unavailable|internal server error|gateway timeout)\b",
    r"(?i)[\"“”]error[\"“”]\s*:\s*\{|[\"“”]code[\"“”]\s*:\s*(?:4|5)\d\d",
    r"(?i)\btraceback \(most recent call last\)|\bfatal error:|\buncaught (?:exception|error)\b(?= in)|\bkeyerror:|\bdatabase connection failed\b",
    r"(?i)\bstack trace:|\bsegmentation fault\b|\bNullPointerException\b|\bException in thread\b",
    r"(?i)\bthe server returned an error\b|\ban (?:unexpected|internal) error (?:has )?occurred\b|\bsomething went wrong\b",
    r"(?i)\brequest id:\s*[0-9a-f#]{5,}",
    r"(?i)\bwe are down for (?:scheduled )?maintenance\b|\bwill be back shortly\b",
    r"(?i)\baccess denied\.|\byou do not have permission to (?:view|access)\b|\byour session has (?:expired|timed out)\b|\bplease log in again to continue\b",
    r"(?i)\bunusual traffic has been detected\b|\bconfirm that you are (?:a human|not a robot)\b|\bchecking your (?:connection|browser) before\b",
    r"(?i)\bwe could not find the page you were looking for\b|\bthe page you (?:requested|are looking for) (?:could not be found|does not exist)\b",
    r"(?i)\bangeforderte seite wurde nicht gefunden\b|\bseite (?:wurde )?nicht gefunden\b|\bsiden blev ikke fundet\b|\bsidan (?:kunde inte visas|hittades inte)\b",
    r"(?i)\bcette page n['’]existe pas\b|\bpagina non trovata\b|\bpágina no encontrada\b|\bpágina não encontrada\b|\bpagina niet gevonden\b",
))
#: Parts of a notice of no fixed wording: something failed, of a site or browser, and an appeal.
FAULT = (
    r"(?i)\b(?:errors?|failed|failure|unavailable|not available|no longer available|expired|timed out|denied|blocked|disabled|unsupported|not supported|could not|couldn['’]t"
    r"|cannot|can['’]t|unable to|not found|missing|went wrong|interrupted|offline|out of order|broken)\b"
)
SYSTEM = (
    r"(?i)\b(?:pages?|sites?|websites?|servers?|browsers?|sessions?|requests?|connections?|cookies|scripts?|javascript|content|listings?|adverts?|documents?|files?|links?"
    r"|databases?|gateways?|services?|applications?|portals?|display(?:ed)?|load(?:ed|ing)?)\b"
)
APPEAL = (
    r"(?i)(?:^|[.!?:;,–-]\s*|\band\s+|\bor\s+)(?:please\s+)?(?:try\s+(?:again|later|another)|reload|refresh|retry|go\s+back|return\s+to|come\s+back|check\s+back|contact\s+(?:the|your|our)\s+\p{L}*\s*"
    r"(?:administrator|support|webmaster|provider|helpdesk)|log\s+in\s+again|sign\s+in\s+again|enable|allow|update\s+your\s+browser|use\s+another\s+browser|clear\s+your)\b|\bplease\s+"
    r"(?:reload|refresh|retry|try|update|allow|enable|contact|wait|check)\b"
)
SCRIPTS_REQUIRED = "|".join((
    r"(?i)<noscript>",
    r"(?i)\b(?:please )?(?:enable|activate|turn on|switch on) (?:javascript|scripts?|scripting)\b(?= (?:to|in)\b)",
    r"(?i)\byou need to (?:turn on|enable|activate) (?:java)?scripts?\b",
    r"(?i)\bdoes(?: not|n['’]t) work (?:properly )?(?:without|with) (?:javascript|scripting|scripts)\b",
    r"(?i)\bjavascript (?:seems to be|is|appears to be) (?:disabled|switched off|turned off)\b",
    r"(?i)\bscripts are required to\b|\bcheck that scripts are allowed\b|\bswitch scripting on\b|\byour browser is not supported\b",
    r"(?i)\baktivieren sie javascript\b|\bjavascript (?:aktivieren|aktiveras)\b|\baktivera javascript\b|\bslå javascript til\b|\baktiver javascript\b",
    r"(?i)\bactiver javascript\b|\bactivez javascript\b|\battiva(?:re)? javascript\b|\bactiva(?:r)? javascript\b|\bative o javascript\b|\bschakel javascript in\b",
    r"(?i)\bloading\.\.\.",
))
#: A unit without any of these can be no message: a cheap test before anything is moved.
#: Every match of a rule holds one of them (tests/llm/test_texts.py proves it by the rules'
#: own alternatives); what only the marks of the mask would make a match is no message.
#: One automaton looks for all of them at once; only repeated words need a pattern.
TRIGGERS = (
    "{", "}", "<", "[", "«", "@@", "#", "%", "$", "*|", "__", "_placeholder", "&lt;", "xxxx", "to be inserted", "to be added", "to be confirmed", "to be filled", "to be announced",
    "undefined", "null", "nan", "none", "invalid date", "nil", "lorem ipsum dolor", "asdf", "qwer", "zxcv", "hjkl", "jkl", "uiop", "yxcv", "heading", "paragraph text",
    "bullet point", "here", "placeholder", "dummy copy", "sample copy", "copy to follow", "coming soon", "publishing", "replaced", "blindtext", "text", "tekst", "texto", "testo",
    "error", "fehler", "erreur", "fejl", "felk", "not found", "forbidden", "unauthorized", "bad ", "gateway", "timeout", "unavailable", "too many", "gone", "status", "message:",
    'code"', "code“", "code”", "traceback", "stack trace", "exception", "fault", "failed", "went wrong", "request id",
    "maintenance", "shortly", "denied", "permission", "session", "log in again", "traffic", "human", "robot", "checking your", "page", "pagina", "página", "seite", "siden", "sidan",
    "script", "browser", "loading", "title:", "location:", "reports to:", "deadline:", "ansøgningsfrist:", "start date:", "salary:", "title :", "location :", "reports to :", "deadline :",
    "ansøgningsfrist :", "start date :", "salary :", "| ref:", "|ref:", "dear ,", "hi ,", "hej ,", "hello ,", "bonjour ,", "hallo ,", "sehr geehrte/r ,",
    # Of four words of Latin filler in a row the second stands between separators.
    *(f"{before}{word}{after}" for word in _LATIN.split("|") for before in " ,." for after in " ,."),
    # Every appeal of a notice.
    "try", "reload", "refresh", "retry", "go back", "return to", "come back", "check back", "contact", "sign in again", "enable", "allow", "update", "clear your", "please wait", "please check",
)
# End of fixed values.

#: A notice of no fixed wording has so many uses in so many sources.
USES, SOURCES = 10, 3

KINDS = (("placeholder", PLACEHOLDER), ("empty_value", EMPTY_VALUE), ("filler", FILLER), ("error_page", ERROR_PAGE), ("scripts_required", SCRIPTS_REQUIRED))


_ODD_SPACE = re.compile(r"[^\S\n\r ][^\S\n\r]*| [^\S\n\r]+")
_LINE = re.compile(r"[\r\n]+")
_CUT = re.compile(r""" (?:(?<=[.!?] )|(?<=[.!?][)"”] ))(?=[^\W\d_a-zß-öø-ÿ{\[]|[{\[<«$#%@*_(])""")
_REPEAT = re.compile(r"(?<![^\W\d_])([^\W\d_]{2,}+)[\s,.]++\1(?![^\W\d_])|(?<![^\W\d_])([^\W\d_]{2,}+\s++[^\W\d_]{2,}+)[\s,.]++\2")


def _automaton():
    a = ahocorasick.Automaton()
    for t in TRIGGERS:
        a.add_word(t, 1)
    a.make_automaton()
    return a


def lines(text: str) -> list[str]:
    """The lines that hold anything, white space within collapsed."""
    return [x for x in (y.strip() for y in _LINE.split(_ODD_SPACE.sub(" ", text))) if x]


def units(text: str) -> list[str]:
    """Lines, cut at sentence ends before a capital or a mark."""
    return [u for line in lines(text) for u in (x.strip() for x in _CUT.split(line)) if u]


def _repeats(low: str) -> bool:
    """Whether a word or a pair of words follows itself.

    Inside a run of four equal words two neighbours are equal, inside three equal pairs
    a word and the next but one: without that the pattern need not be tried.
    """
    ws = low.replace(",", " ").replace(".", " ").split()
    return (True in map(eq, ws, ws[1:]) or True in map(eq, ws, ws[2:])) and _REPEAT.search(low) is not None


def could_be_message(unit: str, triggers) -> bool:
    low = unit.lower()
    return next(triggers.iter(low), None) is not None or _repeats(low)


def candidates(text: str, triggers) -> list[str]:
    """The units of a text that could be messages; a line without a trigger is not cut at all."""
    return [
        u for line in lines(text) if could_be_message(line, triggers)
        for u in (x.strip() for x in _CUT.split(line)) if u and could_be_message(u, triggers)
    ]


def mask(unit: Column) -> Column:
    """The message with what varies between its copies blanked out."""
    m = F.regexp_replace(unit, r"https?://\S+|\bwww\.\S+|[\w.+-]+@[\w-]+\.[\w.]+", "URL")
    m = F.regexp_replace(m, r"\b\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}\b", "DATE")
    m = F.regexp_replace(m, r"\b(?=[0-9a-f]*\d)[0-9a-f]{6,}\b", "HEX")
    # Status codes and list numbers stay: the rules read them.
    return F.regexp_replace(m, r"\d{4,}", "0")


def classify(message: Column) -> Column:
    """Kind of a message, null for ordinary text."""
    out = F.lit(None).cast("string")
    for kind, rule in reversed(KINDS):
        hit = message.rlike(rule)
        if kind == "placeholder":
            hit = hit & F.regexp_replace(message, EXPLAINED, " ").rlike(rule)
        out = F.when(hit, F.lit(kind)).otherwise(out)
    return out


def messages(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str | None = "source") -> DataFrame:
    """(doc, source, hash, message): the masked units that could be messages."""
    src = F.col(source) if source else F.lit(None).cast("string")
    todo = documents.where(F.col(text).isNotNull()).select(F.col(key).alias("doc"), src.alias("source"), F.col(text).alias("t"))
    kind = todo.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        triggers = _automaton()
        for df in batches:
            at, found = [], []
            for i, t in enumerate(df["t"]):
                mine = candidates(t, triggers)
                at += [i] * len(mine)
                found += mine
            if found:  # a column of no strings has no type Arrow could take
                yield pd.DataFrame({"doc": df["doc"].to_numpy()[at], "source": df["source"].to_numpy()[at], "unit": found})

    return (
        todo.mapInPandas(run, f"doc {kind}, source string, unit string")
        .select("doc", "source", mask(F.col("unit")).alias("message"))
        .withColumn("hash", F.xxhash64("message"))
    )


def shape(message: Column) -> Column:
    """Hash of a message with numbers and fields blanked and case ignored: what its copies share."""
    blank = F.regexp_replace(F.regexp_replace(message, PLACEHOLDER, "FIELD"), r"\d+", "0")
    return F.xxhash64(F.lower(F.regexp_replace(blank, r"[^\p{L}\p{N}]+", " ")))


def is_notice(message: Column) -> Column:
    return message.rlike(APPEAL) & message.rlike(FAULT) & message.rlike(SYSTEM)


def message_table(found: DataFrame) -> DataFrame:
    """(hash, message, uses, sources, kind): each distinct message once, classified.

    ``uses`` and ``sources`` are those of its shape.
    """
    per_source = cut(found.groupBy("hash", "message", "source").agg(F.count("*").alias("uses")).withColumn("shape", shape(F.col("message"))))
    spread_over = (
        per_source.groupBy("shape", "source").agg(F.sum("uses").alias("uses"))
        .groupBy("shape").agg(F.sum("uses").alias("shape_uses"), F.count("source").alias("sources"))
    )
    # Cut before the rules: a test of the kind would otherwise be moved below the grouping
    # and run on every unit instead of on every distinct message.
    grouped = cut(per_source.groupBy("hash", "message", "shape").agg(F.sum("uses").alias("uses")).join(spread_over, "shape"))
    recurring = (F.col("shape_uses") >= USES) & (F.col("sources") >= SOURCES)
    kind = F.coalesce(classify(F.col("message")), F.when(recurring & is_notice(F.col("message")), F.lit("notice")))
    return grouped.select("hash", "message", "uses", "shape_uses", "sources", kind.alias("kind"))


def residue(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str | None = "source") -> DataFrame:
    """(doc, kind, messages, widest): kinds of residue a document holds.

    ``messages`` counts its residue messages of that kind, ``widest`` is the largest
    number of sources one of them occurs in.
    """
    # Only units that could be messages are kept, and they are read twice below.
    found = cut(messages(documents, key, text, source))
    # Classified once, and stored before the test of the kind: what is known of a filtered
    # table would otherwise be inferred for the other side of the join and computed there.
    classified = cut(message_table(found))
    kinds = classified.where(F.col("kind").isNotNull()).select("hash", "message", "kind", "uses", "sources")
    return (
        skew_join(found, kinds, ["hash", "message"], "uses", F.col("doc"))
        .groupBy("doc", "kind").agg(F.count("*").alias("messages"), F.max("sources").alias("widest"))
    )
