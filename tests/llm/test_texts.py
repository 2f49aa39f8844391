"""p2, p7, p8, p9: texts, against exact round trips and on edge cases."""

import base64
import os
import random
import re

import pytest

from vacantia.llm import bpe, doclang, leak, residue

VOCABULARY = os.path.join(bpe.DEFAULT_FOLDER, "byte_bpe_50k.tiktoken")
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")


# ---- p2 ----

LINES = {
    "en": "You will work with our team every day and own the results from start to finish.",
    "da": "Vi søger en kollega, som har lyst til at blive en del af vores afdeling.",
    "de": "Sie bringen mindestens drei Jahre Erfahrung aus einer ähnlichen Stelle mit.",
    "fr": "Nous recherchons une personne pour rejoindre notre équipe dans la ville.",
    "es": "Ofrecemos horario flexible, seguro médico y dos días de trabajo desde casa por semana.",
}


def test_segments(spark):
    rows = [
        (1, LINES["en"], "https://a.dk/x"), (2, LINES["en"] + "\n" + LINES["da"] + "\nsql · java\n" + LINES["en"], None), (3, None, "x"), (4, " \n ", "x"), (5, "sql · java · git", "x"), (6, "", None),
        (7, "<p>" + LINES["de"].upper() + "</p>\n" + LINES["de"], "x"), (8, ("\n".join([LINES["fr"]] * 400)), "https://b.example"), (9, LINES["es"], "x"),
    ]
    df = spark.createDataFrame(rows, "id bigint, text string, url string")
    labels = spark.createDataFrame([(1, "en_GB"), (2, "English"), (7, "fr"), (7, "fr"), (8, "??"), (99, "da")], "id bigint, label string")
    got = {}
    for r in doclang.segments(df, labels, "id", "text", "url", "label").collect():
        got.setdefault(r["id"], []).append((r["line_no"], r["lang"], r["declared"], r["mixed"], r["confidence"]))
    got = {k: sorted(v) for k, v in got.items()}
    assert {k: [x[:2] for x in v] for k, v in got.items()} == {1: [(0, "en")], 2: [(0, "en"), (1, "da"), (3, "en")], 7: [(0, "de")], 8: [(0, "fr")], 9: [(0, "es")]}
    assert got[1][0][2] == "en" and got[8][0][2] is None and got[7][0][2] == "fr"
    assert all(x[3] for x in got[2]) and not got[1][0][3]
    assert all(0.5 < x[4] <= 1.0 for v in got.values() for x in v)
    assert doclang.segments(df.limit(0), labels, "id", "text", "url", "label").count() == 0
    assert doclang.segments(df, labels.limit(0), "id", "text", "url", "label").count() == 7


def test_evidence_decides_what_words_leave_open(spark):
    model = doclang.seed_model()
    weak = "sql java\nwerk hybrid\nteam die git"  # one telling word, German or Dutch
    rows = [
        (1, weak, "https://jobs.example/1"), (2, weak, "https://jobs.example/2"), (3, '<div lang="de">\n' + weak, "https://jobs.example/3"), (4, weak, "https://firma.de/4"),
        (5, LINES["en"] + "\n" + LINES["en"] + "\n" + LINES["en"] + "\nteam die git\n" + LINES["en"], "https://jobs.example/5"),
    ]
    rows += [(100 + i, LINES["de"], "https://a.firma.de/x") for i in range(60)] + [(200 + i, LINES["en"], "https://jobs.example/x") for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, text string, url string")
    labels = spark.createDataFrame([(1, "de"), (2, "en"), (5, "de")] + [(100 + i, "de") for i in range(60)] + [(200 + i, "en") for i in range(60)], "id bigint, label string")
    run = lambda w: {(r["id"], r["line_no"], r["lang"]) for r in doclang.segments(df, labels, "id", "text", "url", "label", model, w).collect() if r["id"] < 100}
    got, alone = run(1.0), run(0.0)
    # The label, the markup or the host settle a single telling word; a label the text contradicts does not.
    assert {(1, 2, "de"), (3, 3, "de"), (4, 2, "de")} <= got and not any(i == 2 for i, _, _ in got)
    assert {x for x in got if x[0] == 5} == {(5, 0, "en")} == alone


def test_priors_are_smoothed_by_domain_and_suffix(spark):
    meta = spark.createDataFrame([("a.firma.dk", "da")] * 90 + [("b.firma.dk", None), ("c.other.dk", None), ("d.new.example", None)] + [("x.example", "en")] * 300, "host string, declared string")
    prior = {r["host"]: dict(zip(doclang.LANGUAGES, r["prior"])) for r in doclang.host_priors(meta).collect()}
    order = [prior[h]["da"] for h in ("a.firma.dk", "b.firma.dk", "c.other.dk", "d.new.example")]
    assert order == sorted(order, reverse=True) and len(set(order)) == 4


# ---- p7 ----


@pytest.fixture(scope="module")
def coders():
    import tiktoken

    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return bpe.PrefixEncoder(ranks), tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_text(rnd, n):
    kind = rnd.random()
    if kind < 0.4:
        return "".join(rnd.choices("abcdefgh \n\tABCéøß0123…😀_-'s", k=n))
    if kind < 0.7:
        return "".join(chr(rnd.choice((rnd.randint(0, 0x2FFF), rnd.randint(97, 122), 32))) for _ in range(n))
    return " ".join(rnd.choices(["The", "engineer", "Rüntagarsted", "it's", "2024", "<|endoftext|>", "  ", "\r\n", "求人"], k=n // 3 + 1))


@needs_vocabulary
def test_prefix_encoding_equals_reference(coders):
    own, other = coders
    rnd = random.Random(11)
    for _ in range(3000):
        t = random_text(rnd, rnd.randint(0, 40))
        ids = own.encode(t)
        assert ids == other.encode_ordinary(t)
        assert own.decode(ids) == t
    t = "word " * 20_000 + "x" * 3000
    assert own.encode(t) == other.encode_ordinary(t)


@needs_vocabulary
def test_appends_and_edits(coders):
    own, other = coders
    rnd = random.Random(12)
    for _ in range(200):
        t = bpe.EncodedText(own, random_text(rnd, 30))
        for _ in range(4):
            more = random_text(rnd, rnd.randint(0, 6))
            before = t.text
            t.append(more)
            assert t.text == before + more and t.ids == other.encode_ordinary(t.text)
            a = rnd.randint(0, len(t.text))
            b = min(len(t.text), a + rnd.randint(0, 5))
            want = t.text[:a] + more + t.text[b:]
            t.replace(a, b, more)
            assert t.text == want and t.ids == other.encode_ordinary(want)


@needs_vocabulary
def test_entries_of_a_prefix_never_change(coders):
    own, _ = coders
    data = "internationalisation".encode()
    whole = own.extend(data, [])
    for n in range(len(data) + 1):
        assert own.extend(data[:n], []) == whole[:n]
        assert own.read(whole, n) == own._merge(data[:n]) if n else own.read(whole, 0) == []


@needs_vocabulary
def test_encode_column(spark):
    df = spark.createDataFrame([(1, "a b", 5), (2, None, 5), (3, "", 5), (4, "  ", 5), (1, "a b", 5)], "doc_id bigint, text string, ids int")
    got = sorted((r["doc_id"], r["ids"]) for r in bpe.encode_column(df, "doc_id", "text").collect())
    assert got[0] == got[1] and got[2:4] == [(2, []), (3, [])] and len(got[4][1]) > 0
    assert bpe.encode_column(df.limit(0), "doc_id", "text").count() == 0


# ---- p8 ----


def test_leaks(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choices("abcdefghij", k=6))
    passages = [[word() for _ in range(60)] for _ in range(30)]
    items = [(i, " ".join(p).capitalize() + ".", "noise") for i, p in enumerate(passages)] + [(90, None, "x"), (91, " ", "x"), (92, "short but whole passage of nine words in all", "x")]
    docs, want = [], set()
    for n in range(120):
        p = rnd.randrange(30)
        filler = " ".join(word() for _ in range(rnd.randint(0, 80)))
        kind = n % 4
        size = {0: 60, 1: rnd.randint(18, 40), 2: rnd.randint(3, 8), 3: rnd.randint(24, 50)}[kind]
        at = rnd.randint(0, 60 - size)
        part = passages[p][at : at + size]
        if kind == 3:
            part = [word() if i % 10 == 4 else w for i, w in enumerate(part)]
        style = rnd.choice([" ".join, lambda ws: "<p>" + ",&nbsp;".join(ws) + "</p>", lambda ws: "\n> ".join(ws).upper(), lambda ws: " <b>".join(ws)])
        docs.append((n, f"{filler} {style(part)} {filler}", 1))
        if kind != 2:
            want.add((n, p))
    docs += [(500, None, 1), (501, "", 1), (502, "... <b>", 1), (503, "It is SHORT, but whole passage of nine words in all!", 1), (0, docs[0][1], 1), (504, ("pad " * 50_000) + " ".join(passages[0]), 1)]
    docs += [(505, " ".join(passages[1][:12]) + f'<a href="{"x" * 900}">' + " ".join(passages[1][12:24]) + "</a> 1 < 2", 1)]
    want |= {(503, 92), (504, 0), (505, 1)}
    d = spark.createDataFrame(docs, "doc_id bigint, text string, words int")
    i = spark.createDataFrame(items, "item_id bigint, passage string, words string")
    got = [(r["doc_id"], r["item_id"]) for r in leak.leaks(d, i).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # Wording that all items share costs none of them a case.
    shared = " ".join(passages[0][:40])
    many = spark.createDataFrame([(k, f"{shared} {' '.join(passages[k][40:])}", "x") for k in range(30)], "item_id bigint, passage string, words string")
    some = spark.createDataFrame([(1, " ".join(passages[0][5:25]), 1)], "doc_id bigint, text string, words int")
    assert leak.leaks(some, many).count() == 30
    assert leak.leaks(d.limit(0), i).count() == 0
    assert leak.leaks(d, i.limit(0)).count() == 0


# ---- p9 ----

RESIDUE = [
    "Hej {{first_name}},", "Salary: {0} - XXXX", "Location: <<Deadline>>", "Dear [BENEFITS],", "Your new team, &lt;contact_email&gt;, is waiting for you.", "About <job title>", "*|COMPANY|*", "«Location»",
    "(team size to be inserted)", "[Insert deadline here]", "[indsæt benefits]", "Hej [Manager einfügen],", "{% manager %}", "<%= salary_range %>", "BENEFITS_PLACEHOLDER", "__TEAM_SIZE__", "%DEADLINE%", "$SALARY_RANGE$",
    "Posted on null", "Welcome to NaN!", "Salary: undefined - undefined EUR", "Location: #REF!, (null)", "None (NaN people)", "Hej Invalid Date,", "Posted on [object Object]",
    "Lorem ipsum dolor sit amet.", "Velit dolor ultrici blandi mollum aliquet.", "qwer asdf zxcv hjkl", "bla bla bla bla bla", "foo bar foo bar foo bar foo bar", "Your content here.", "Description coming soon.", "Paragraph text 3",
    "404 Not Found", "403 FORBIDDEN", "Erreur 504 : cette page n'existe pas ou n'est plus disponible.", "Siden blev ikke fundet. Fejlkode 401.", '{"error": {"code": 502, "message": "Bad Gateway"}}', "Traceback (most recent call last):",
    "Access denied. You do not have permission to view this page.", "We are down for scheduled maintenance and will be back shortly.", "Oops! We could not find the page you were looking for.",
    "Please enable JavaScript to apply.", "You need to turn on scripts in your browser to continue.", "Aktivera JavaScript i webbläsaren för att fortsätta.", "<noscript>Scripts are required to show this content.</noscript>",
]
PROSE = [
    "You will write mail templates with placeholders such as {{first_name}} and check that every one is filled.", "Send code samples as <name>.zip or as a link; {} and [] in the text are fine.",
    "You maintain the script that turns ${name} variables in our letters into text.", "Fields in [square brackets] of our contract are explained in annex 7.", "Salary band [B2], grade 206, see the table in the handbook.",
    "Our designers refuse to work with lorem ipsum; every draft uses real adverts.", "Our style guide forbids filler words, sample text and anything that sounds like a brochure.",
    "Last year the team cut the number of 404 pages on our site by 138 percent.", "In November we replaced the old error messages; the 500 page now says who is on call.",
    "Experience with error pages, timeouts and 503 responses under load is part of the job.", "JavaScript is required for this role, and pytest would be a welcome extra.",
    "We test what happens when scripts are switched off in the browser of a customer.", "Please enable your camera for the second interview and mute the microphone.", "A NaN in the Imaging table once cost us a full day.",
    "The candidate explained why an undefined value reached the salary field and how null was handled.", "Home | Jobs | Employers | Log in", "The word test appears 162 times in this advert.", "Cookie settings", "return None", "",
]


def test_residue(spark):
    good = "The team reports to the head of Pricing. Hours are 137 per week, with core time from ten to three."
    rows = [(i, f"{good} {m}" if i % 2 else f"{good}\n{m}\n{good}", "s") for i, m in enumerate(RESIDUE)] + [(1000 + i, f"{good} {m} {good}", "s") for i, m in enumerate(PROSE)]
    rows += [(2000, None, "s"), (2001, " \n ", None), (0, rows[0][1], "t"), (2002, (good + "\n") * 3000 + "XXXX", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 AS doc", "'x' AS kind")
    found = {r["doc"] for r in residue.residue(df).select("doc").distinct().collect()}
    assert found == set(range(len(RESIDUE))) | {2002}
    assert residue.residue(df.limit(0)).count() == 0
    wide = {r["message"]: (r["uses"], r["sources"]) for r in residue.message_table(residue.messages(df)).collect() if r["kind"]}
    assert wide["Hej {{first_name}},"] == (2, 2)


def matches_of(rule: str, n: int):
    """Texts of a rule's form: every alternative at least once, repetitions at random."""
    plain = rule.replace("(?i)", "").replace("(?i:", "(?:")
    tree = re._parser.parse(re.sub(r"\\p\{\w+\}", r"\\w", plain))
    rnd, turns = random.Random(9), {}

    def next_of(node, choices):
        turns[id(node)] = turns.get(id(node), rnd.randrange(len(choices))) + 1
        return choices[turns[id(node)] % len(choices)]

    def text(seq, groups):
        out = ""
        for op, arg in seq:
            match str(op):
                case "LITERAL":
                    out += chr(arg)
                case "IN":
                    kind, value = next_of(arg, arg)
                    out += rnd.choice({"LITERAL": lambda: chr(value), "RANGE": lambda: chr(value[0]), "CATEGORY": lambda: {"CATEGORY_SPACE": " ", "CATEGORY_DIGIT": "04"}.get(str(value), "Qk")}[str(kind)]())
                case "BRANCH":
                    out += text(next_of(arg[1], arg[1]), groups)
                case "SUBPATTERN":
                    got = text(arg[3], groups)
                    groups[arg[0]] = got
                    out += got
                case "MAX_REPEAT" | "MIN_REPEAT" | "POSSESSIVE_REPEAT":
                    out += "".join(text(arg[2], groups) for _ in range(rnd.randint(arg[0], min(arg[1], arg[0] + 1))))
                case "GROUPREF":
                    out += groups[arg]
                case "ANY":
                    out += "."
                case "ASSERT" | "ASSERT_NOT" | "AT":
                    pass
                case other:
                    raise ValueError(other)
        return out

    for _ in range(n):
        yield text(tree, {})


@pytest.mark.parametrize("kind, rule", residue.KINDS)
def test_every_match_of_a_rule_could_be_a_message(kind, rule):
    triggers = residue._automaton()
    lost = set()
    for t in matches_of(rule, 20_000):
        # White space of a unit is collapsed.
        unit = " ".join(t.split())
        if not all(residue.could_be_message(u, triggers) for u in (unit, unit.upper())):
            lost.add(unit)
    assert not lost


def test_messages_the_gate_dropped(spark):
    rows = [
        "503 Service Unavailable", "Sehr geehrte/r ,", "Stack trace: at a.b", "This is a dummy copy", "This is a sample copy", "Donec etiam mauris proin", "consectetur adipiscing elit sed",
        '"code": 502', "Title :", "Reports to : -", "Seller |Ref:", "Nunc, orci, augue, turpis.",
    ]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").selectExpr("*", "'s' AS source")
    assert {r["doc"] for r in residue.residue(df).collect()} == set(range(len(rows)))
    clean = spark.createDataFrame([(1, "Kind regards", "s")], "doc_id bigint, text string, source string")
    assert residue.residue(clean).count() == 0


def test_recurrence_tells_unlisted_notices(spark):
    notice = "Sorry, listing {} cannot be displayed right now, please reload or come back later, reference {}."
    say = "We test what happens when the page cannot be displayed in the browser of customer {}."
    rows = [(i, "Own words here.\n" + notice.format(i, 7 * i), f"s{i % 4}") for i in range(12)] + [(100 + i, say.format(i), f"s{i % 4}") for i in range(12)]
    # The same wording in one source only, and too seldom, is told by nothing.
    rows += [(200 + i, f"This form could not load; please try again, visitor {i}.", "s1") for i in range(12)]
    rows += [(300 + i, f"The portal is offline, please check at {i} o'clock.", f"s{i}") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert {(r["doc"], r["kind"]) for r in residue.residue(df).collect()} == {(i, "notice") for i in range(12)}


def test_the_word_model_is_of_all_texts(spark):
    line = "we are looking for a person who would like to work with the team and "
    # Far more texts than any sample would take; the rare words are in 5 of them.
    df = spark.range(60_000).selectExpr("id", f"concat('{line}', CASE WHEN id % 12000 = 0 THEN 'qwertzuiop' ELSE 'colleagues' END) AS t")
    model = doclang.fit(df, "id", "t")
    assert "qwertzuiop" in model.at and "colleagues" in model.at
