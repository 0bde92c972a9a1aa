"""The training-data operators on small fixtures: brute force, round trips and hard inputs."""

import random
import time
from collections import Counter, defaultdict

import pytest

from lexspark.llm import common, encode, formatdup, langid, lookalike, mixing, mojibake, pii, quality, sentences, termfreq
from lexspark.llm.common import texts

HARD = [None, "", " \n\t", "x" * 300_000, "a.b " * 60_000, "(" * 50_000, "<" * 20_000, "1" * 50_000, "a.a." * 20_000 + "@", "\0￾\U0010ffff", "“" * 9, "క్" * 30_000]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def fields(spark, values, extra=False):
    df = frame(spark, [("f", i, v) for i, v in enumerate(values)], "field string, rec_id bigint, text string")
    return df.selectExpr("*", "'x' as kind", "1 as lang", "2 as h", "3 as tokens", "4 as _text") if extra else df


# ---- 1 personal information
PARTS = "Lokuba Panitani Rudepa Vikosheba Magamo Tirule Sheveni Kodipa Ranuve Bajiko కోరమో తసుదిబ వేకులో నిగసు మాదిప తిరులే कोरमो तसुदिब वेकुलो निगसु मादिप तिरुले".split()
BACKGROUND = ["The train went to the market when the water was high and nobody asked for bread. Table and stone were cheap.", "రైలు నగరం వచ్చింది మరియు పిల్లలు ఆడుకున్నారు. చెట్టు పక్కన ఇల్లు ఉంది.", "बच्चे बाज़ार में खेलते हैं और पानी ठंडा है. मकान पुराना था."] * 4
MODEL = pii.NameModel(PARTS, BACKGROUND, {"en": "the and of to in we you it on for yesterday".split()})
NOBODY = pii.NameModel([], BACKGROUND, {"en": "the and of".split()})
KEY = b"a key of this test"


def found(text, model=MODEL):
    return [(k, text[a:b]) for a, b, k in pii.finder(model)(text)]


PII = [
    ("Please write to info @ post.example before Friday.", [("email", "info @ post.example")]),
    ("mail a.b+c(at)mail.nilayam.example, or x [at] y [dot] test.", [("email", "a.b+c(at)mail.nilayam.example"), ("email", "x [at] y [dot] test")]),
    ("Follow @lokuba_news. Invoice INV-2016-149446, order 1234 5678 9012.", []),
    ("Call Lokuba Panitani on +91 55201 69175 or (305) 555-0102.", [("name", "Lokuba Panitani"), ("phone", "+91 55201 69175"), ("phone", "(305) 555-0102")]),
    ("Her passport (0550 2432 2288), Tax card CASXC6478N; part ZX482982.", [("id_number", "0550 2432 2288"), ("id_number", "CASXC6478N")]),
    ("The Panitani College; Lokuba & Sons on Lokuba Street.", []),
    ("Signed: Rudepa, Vikosheba. Mrs. R. Vikosheba lives at Flat 2, 213 Nasu Lane, Shediton 029333, here.", [("name", "Rudepa, Vikosheba"), ("name", "R. Vikosheba"), ("address", "Flat 2, 213 Nasu Lane, Shediton 029333")]),
    ("డా. కోరమో తసుదిబ ఫోన్ ౦౪౦-౫౫౫౫౦౦. ఆ కుటుంబం ఇంటి నం. 9-2/B, షేని వీధి, గసపురం - 030633 లో", [("name", "కోరమో తసుదిబ"), ("phone", "౦౪౦-౫౫౫౫౦౦"), ("address", "ఇంటి నం. 9-2/B, షేని వీధి, గసపురం - 030633")]),
    ("Envoyez au 90 rue Moku, 00090 Lopaville. Pashestraße 102, 00102 Mavidorf", [("address", "90 rue Moku, 00090"), ("address", "Pashestraße 102, 00102")]),
    ("ｉｎｆｏ＠ｐｏｓｔ．ｅｘａｍｐｌｅ", [("email", "ｉｎｆｏ＠ｐｏｓｔ．ｅｘａｍｐｌｅ")]),
    ("We met Dr. Olivia Bennett and a man. Yesterday Olivia Bennett left; in the New York papers it says so.", [("name", "Olivia Bennett")] * 2),
    ("She was born on 29.02.2000 in a town. The market of 12.05.2001 was good.", [("birth_date", "29.02.2000")]),
]


@pytest.mark.parametrize("text,want", PII)
def test_items(text, want):
    assert found(text) == want


#: a name in a sentence, with the words around it exchanged
AROUND = [
    "Yesterday {} left early.", "Today {} left early.", "Ring {} at noon.", "Ask {} about it.", "My name is {} and I sing.", "It belongs to {} now.", "Gestern kam {} nach Hause.", "Morgen fragt {} nach Brot.",
    "Demain {} vient nous voir.", "Mañana {} viene a casa.", "Llame a {} por la tarde.", "Saludos de {} a todos.", "Nobody saw {} again.", "Written by {}.",
]
AROUND_INDIC = ["నిన్న {} వచ్చారు.", "రేపు {} వస్తారు.", "ఈ పుస్తకం {} రాశారు.", "మా ఊరిలో {} ఉన్నారు.", "कल {} घर आए.", "आज {} से मिलो.", "यह किताब {} ने लिखी."]


@pytest.mark.parametrize("frame_", AROUND + AROUND_INDIC)
def test_names_whatever_stands_around(frame_):
    names = ["Lokuba Panitani", "Rudepa Magamo", "Sheveni R. Kodipa"] if frame_ in AROUND else ["కోరమో తసుదిబ", "వేకులో నిగసు"] if frame_[0] < "\u0900" or "ఀ" <= frame_[0] else ["कोरमो तसुदिब", "वेकुलो निगसु"]
    for name in names:
        assert found(frame_.format(name)) == [("name", name)]


def test_the_list_carries_the_names():
    texts = [f.format(n) for f in AROUND_INDIC[:4] for n in ("కోరమో తసుదిబ", "వేకులో నిగసు")] + [f"{n} sang." for n in ("Lokuba Panitani", "Rudepa Magamo")]
    assert sum(len(found(t)) for t in texts) == len(texts) and sum(len(found(t, NOBODY)) for t in texts) == 0
    # parts that the list doesn't hold but that are made like its parts
    assert found("మా ఊరిలో నిదిప తసులే ఉన్నారు.") == [("name", "నిదిప తసులే")]


@pytest.mark.parametrize("mail", ["info ( at ) mail.example", "info [ at ] mail.example", "info(At)mail.example", "info { At } mail.example", "info at mail DOT example", "info at\tmail\tdot example"])
def test_spelled_signs_alone_in_a_text(mail):
    assert list(pii.finder(MODEL)("Write to " + mail + " today")) == [(9, 9 + len(mail), "email")]


def test_permutation_is_one():
    assert {pii.permute(v, 10, 10, KEY) for v in range(100)} == set(range(100))
    values = {f"{a}{d}" for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for d in range(10)}
    assert {pii.permute_form(v, KEY, "x") for v in values} == values
    assert {pii.permute_form(str(v), KEY, "x") for v in range(10)} == set("0123456789")


def test_pseudonyms_keep_format_and_come_back():
    rnd = random.Random(1)
    for kind in ("phone", "id_number"):
        for _ in range(60):
            t = "".join(rnd.choice("0123456789 -") for _ in range(14)) + ("x7K" if kind == "id_number" else "")
            p = pii.pseudonym(t, KEY, kind)
            assert [("9" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c) for c in t] == [("9" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c) for c in p]
            assert pii.pseudonym(p, KEY, kind, back=True) == t and pii.pseudonym(t, KEY, kind) == p
    assert pii.pseudonym("౦౪౦-౫౫౫౫౧౨", KEY, "phone") != "౦౪౦-౫౫౫౫౧౨" and pii.pseudonym("9876543210", KEY, "phone") != pii.pseudonym("9876543210", b"other", "phone")
    for d in ((29, 2, 2000), (1, 1, 1900), (31, 12, 1999)):
        assert pii.date_pseudonym(*pii.date_pseudonym(*d, KEY), KEY, back=True) == d
    assert pii.date_pseudonym(30, 2, 2000, KEY) is None


@pytest.mark.parametrize("ways", [["9876543210", "+91 98765 43210", "098765 43210", "0091-98765-43210"], ["555-123-4567", "+1 555-123-4567", "(555) 123 4567"]])
def test_one_number_in_all_notations(ways):
    digits = lambda t: "".join(c for c in t if c.isdigit())
    out = {digits(pii.pseudonym(w, KEY, "phone"))[-10:] for w in ways}
    assert len(out) == 1 and out != {digits(ways[0])}
    for w in ways:  # country code and trunk zero stay
        assert digits(pii.pseudonym(w, KEY, "phone"))[:-10] == digits(w)[:-10]
    assert len({pii.pseudonym(w, KEY, "id_number").replace(" ", "").replace("-", "").upper() for w in ("ABCDE1234F", "abcde1234f", "ABCDE 1234-F")}) == 1


def test_check_digits_stay_right():
    # published examples of the checks: Verhoeff 236 -> 3, Luhn 7992739871 -> 3, the DNI 12345678Z
    assert pii._verhoeff("236") == "3" and pii._luhn("7992739871") == "3" and pii.checked("12345678Z") and not pii.checked("12345678A")
    rnd = random.Random(4)
    for form, (n, make) in pii.CHECKS.items():
        seen = set()
        for _ in range(40):
            body = "".join(rnd.choice("0123456789") for _ in form[:-n])
            right = body + make(body)
            wrong = next(w for w in (body + (str(d) * n if form[-1] == "9" else "ABC"[d % 3]) for d in range(10)) if not pii.checked(w))
            a, b = pii.pseudonym(right, KEY, "id_number"), pii.pseudonym(wrong, KEY, "id_number")
            assert pii.checked(a) and not pii.checked(b) and pii.pseudonym(a, KEY, "id_number", back=True) == right and pii.pseudonym(b, KEY, "id_number", back=True) == wrong
            seen |= {a, b}
        assert len(seen) >= 78
    p = pii.pseudonym("ABCDE1234F", KEY, "id_number")
    assert sum(x != y for x, y in zip(p, "ABCDE1234F")) > 5  # letters too


def test_many_items_in_one_text():
    began = time.time()
    assert len(found("a@b.example, " * 20_000)) == 20_000 and time.time() - began < 20


def test_sample_of_texts_is_bounded(spark):
    df = spark.range(5000).selectExpr("if(id % 50 = 0, null, concat('text number ', id, repeat(' x', if(id % 7 = 0, 900, 1)))) as t")
    got = common.bucket_sample(df, "t", 100, 500)
    assert 90 <= len(got) <= 100 and max(map(len, got)) <= 500 and got == common.bucket_sample(df.repartition(5), "t", 100, 500)
    assert common.bucket_sample(df.where("t is null"), "t", 100, 500) == [] == common.bucket_sample(df.limit(0), "t", 100, 500)
    assert len(common.bucket_sample(df.where("t is not null").limit(30), "t", 10_000, 5000)) == 30


def test_model_of_names_counts_all_texts(spark, monkeypatch):
    monkeypatch.setattr(pii, "COUNTED_WORDS", 50)
    names = frame(spark, [("Lokuba", "x"), ("Panitani", "x"), ("మహేష్", "x")], "name_text string, script string")
    common_words = frame(spark, [("en", "the")], "lang string, word string")
    # more texts than a sample of 4,000 held; a long one too
    texts = [f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]} Lokuba the తెలుగు మాట {'zyx' if i % 90 == 0 else ''}" for i in range(9000)] + ["qwv " * 8000, None, ""]
    model = pii.fit(fields(spark, texts), names, common_words)
    whole = pii.NameModel(["Lokuba", "Panitani", "మహేష్"], [t for t in texts if t is not None], {"en": ["the"]})
    assert (model.known, model.common, model.odds) == (whole.known, whole.common, whole.odds)
    assert "^qw" in model.odds["Latin"] and "zyx" in model.common


def test_masked(spark):
    names = frame(spark, [("Lokuba", "x"), ("Panitani", "x"), (None, "x"), (" ", "x")], "name_text string, script string")
    common = frame(spark, [("en", "the")], "lang string, word string")
    df = fields(spark, ["Mail a@b.example, tel (305) 555-0102. Lokuba Panitani was born on 01.02.1990.", None, "", "no one here"], True)
    model = pii.fit(df, names, common)
    rows = {r.rec_id: r for r in pii.masked(df, model, KEY).collect()}
    assert rows[0].masked == "Mail [EMAIL], tel [PHONE]. [NAME] was born on [BIRTH_DATE]." and rows[0].pseudonymized.startswith("Mail [EMAIL], tel (")
    assert "01.02.1990" not in rows[0].pseudonymized and "[BIRTH_DATE]" not in rows[0].pseudonymized
    assert rows[1].masked is None and rows[2].masked == "" and rows[0].n_items == 4 and rows[3].masked == "no one here"
    assert {(r.kind, r.start_pos) for r in pii.places(df, model).collect()} == {(r.kind, r.start_pos) for r in pii.items(df, model, KEY).collect()}
    assert pii.places(df.limit(0), pii.fit(df.limit(0), names.limit(0), common.limit(0))).count() == 0
    for t in HARD[1:]:
        pii.finder(model)(t)


# ---- 2 and 7
ALIKE = [("ఆయన ಇలా", "ఆయన ఇలా"), ("rаnk", "rank"), ("ｐｏｓｔ．", "post."), ("e​xam", "exam"), ("ﬁlm", "film"), ("café", "café"), ("a b", "a b"), ("сор", "cop"), ("ర‌కం", "రకం"), ("తై", "తై")]
UNLIKE = [("m²", "m2"), ("a  b", "a b"), ("a\tb", "a b"), ("Abc", "abc"), ("గ్‌రా", "గ్రా"), ("a.", "a")]


@pytest.fixture(scope="session")
def letters(spark):
    return lookalike.shapes(spark)


def test_consistent_form(letters):
    n = lookalike.normalizer(letters)
    for a, b in ALIKE:
        assert n(a) == n(b), (a, b)
    for a, b in UNLIKE:
        assert n(a) != n(b), (a, b)
    for t in HARD[1:]:
        assert n(n(t)) == n(t)


@pytest.mark.parametrize("a,b", [("\u0c95\u0c02\u0cac", "\u0c95\u0c82\u0cac"), ("\u043c\u0438p", "\u043c\u0438\u0440"), ("caf\u0435\u0301", "caf\u00e9"), ("\u0450", "\u00e8"), ("\u0432\u0441\u00e8", "\u0432\u0441\u0450"), ("\u03ba\u03b1\u03bb\u00f3", "\u03ba\u03b1\u03bb\u03cc")])
def test_borrowed_letters_of_any_script(letters, a, b):
    n = lookalike.normalizer(letters)
    assert n(a) == n(b) and formatdup.canonicalizer(letters)(a) == formatdup.canonicalizer(letters)(b)


#: Cherokee, Lisu, Coptic, Greek and Cyrillic ka, small capitals, Tamil and Malayalam
@pytest.mark.parametrize("a,b", [("\u13aa\u13d5", "AS"), ("\ua4ee\ua4d0\ua4e0\ua4d2", "\ua4ee\ua4d0\ua4e0\ua4d2"), ("\ua4e3\ua4f3\ua4d6", "DOG"), ("\u2c9f\u2ca3\u2ca5", "opc"), ("\u03ba\u03bf\u03c4", "\u043ao\u03c4"), ("\u1d04\u1d0f\u1d20", "cov"), ("\u0baf\u0b9c", "\u0baf\u0b9c"), ("\u03bf\u03c5", "\u03bfu")])
def test_shapes_of_the_standard(letters, a, b):
    n = lookalike.normalizer(letters)
    if a.isascii() or a == b:
        assert n(a) == n(b)
        return
    same = [x in letters and y in letters and letters[x] is letters[y] or x == y for x, y in zip(a, b)]
    assert (n(a) == n(b)) == all(same)


@pytest.mark.parametrize("a,b", [("\u13aa", "A"), ("\ua4ee", "A"), ("\ua4f3", "O"), ("\u2c9f", "o"), ("\u03ba", "\u043a"), ("\u1d0f", "o"), ("\u0b9f", "\u0b9f"), ("\u0d20", "o"), ("\u0440", "\u2ca3"), ("\u0c95\u1cd0\u0c02\u0cac", "\u0c95\u1cd0\u0c82\u0cac"), ("p\u02b0\u0430", "p\u02b0a")])
def test_letters_of_one_shape(letters, a, b):
    n = lookalike.normalizer(letters)
    assert n(a) == n(b)


def test_alike_tokens_get_one_spelling(letters):
    """Any letters of a token exchanged for others of their shape: the same form."""
    rnd = random.Random(5)
    n = lookalike.normalizer(letters)
    members = defaultdict(list)
    for c, shape in letters.items():
        members[id(shape)].append(c)
    pool = sorted(letters)
    for _ in range(8000):
        a = [rnd.choice(pool) if rnd.random() < 0.6 else rnd.choice("bdfgqrzабвгдеαβγδకగచಕಗక్తअکமകഹ") for _ in range(rnd.randint(1, 6))]
        b = [rnd.choice(members[id(letters[c])]) if c in letters and rnd.random() < 0.7 else c for c in a]
        assert n("".join(a)) == n("".join(b)), (a, b)


def test_ordinary_letters_stay_apart(letters):
    n = lookalike.normalizer(letters)
    for alphabet in ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "αβγδεζηθικλμνξοπρστυφχψωςΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "абвгдежзийклмнопрстуфхцчшщъыьэюяАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցւփքօֆ", *("".join(map(chr, range(o, o + 0x80))) for o in (0x900, 0xB80, 0xC00, 0xC80, 0xD00, 0x13A0))):
        words = [c for c in alphabet if c.isalnum()]
        assert len({n("x " + c) for c in words}) == len({__import__("unicodedata").normalize("NFC", c) for c in words}), alphabet
    # a shape's letters are of one case
    for shape in letters.values():
        assert len({c.isupper() for c in shape.values() if c.isupper() or c.islower()}) < 2


def test_mixed_and_whole_script_tokens(spark):
    df = fields(spark, ["rаnk of сор and rank", "слово", None, "日本語のテスト", "\u13aa\u13d5 x"], True)
    rows = {r.rec_id: r for r in lookalike.normalize_corpus(df, ["field", "rec_id"], "text").collect()}
    assert [(rows[i].mixed_script, rows[i].whole_script) for i in range(5)] == [(1, 1), (0, 0), (0, 0), (0, 0), (0, 1)]
    assert rows[0].normalized == "rank of cop and rank" and rows[2].normalized is None and not rows[1].changed


def test_same_looking_pairs(spark):
    values = ["rank", "rаnk", "rank", "ｒａｎｋ", None, "", "..", "．．", "Rank"]
    df = fields(spark, values, True)
    got = {(r.first_id, r.other_id) for r in lookalike.same_looking(lookalike.look_keys(df)).collect()}
    assert got == {(0, 1), (0, 3)}
    assert lookalike.same_looking(lookalike.look_keys(df.limit(0))).count() == 0


def test_hot_groups_are_broadcast(spark, monkeypatch):
    """A third of all rows in one group, found by the sketch: same result, and its rows take no part in the shuffle."""
    df = spark.range(6000).selectExpr("'f' as field", "id as rec_id", "if(id % 3 = 0, if(id % 2 = 0, 'rank', 'rаnk'), concat(if(id % 2 = 0, 'т', 't'), id div 4)) as text")
    keys = lookalike.look_keys(df)
    words = formatdup.keyed(df, "rec_id", "text")
    cold = [sorted(map(tuple, x.collect())) for x in (lookalike.same_looking(keys), formatdup.copies(words))]
    monkeypatch.setattr(common, "HOT_ROWS", 500)
    hot = lookalike.same_looking(keys), formatdup.copies(words)
    assert [sorted(map(tuple, x.collect())) for x in hot] == cold and all(cold)
    for x in hot:
        plan = x._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=broadcast" in plan and "Union" in plan


def test_hot_group_is_whole(spark):
    df = spark.range(4000).selectExpr("'f' as field", "id as rec_id", "if(id % 3 = 0, if(id % 2 = 0, 'rank', 'rаnk'), concat('t', id)) as text")
    assert lookalike.same_looking(lookalike.look_keys(df)).count() == sum(1 for i in range(0, 4000, 3) if i % 2)


DUPS = ["ధర : 5 ; Color : Red", "color:red|ధర:5.", "ధర : Red ; Color : 5", "A b, c", "ab c!", "a c b", "1.5 x", "15 x", None, "..", "  ", "1.5 X"]


def test_format_duplicates(spark):
    df = frame(spark, [(i, v, 1) for i, v in enumerate(DUPS)] + [(3, "A b, c", 2)], "sent_id bigint, t string, k1 int")
    keys = formatdup.keyed(df, "sent_id", "t")
    assert {(r.first_id, r.copy_id) for r in formatdup.copies(keys).collect()} == {(0, 1), (3, 4), (6, 11)}
    assert {(r.first_id, r.copies) for r in formatdup.copy_counts(keys).collect()} == {(0, 2), (2, 1), (3, 3), (5, 1), (6, 2), (7, 1)}
    assert formatdup.copies(formatdup.keyed(df.limit(0), "sent_id", "t")).count() == 0


def test_collisions_are_reported_and_kept_apart(spark):
    keys = frame(spark, [(1, 7, 8, 5), (2, 7, 8, 5), (3, 7, 8, 6), (4, 7, 9, 5), (5, 7, 8, 6)], "id bigint, k1 bigint, k2 bigint, chk bigint")
    assert [(r.k1, r.k2, r.records, r.first_id) for r in formatdup.collisions(keys).collect()] == [(7, 8, 4, 1)]
    assert {(r.first_id, r.copy_id) for r in formatdup.copies(keys).collect()} == {(1, 2), (3, 5)}
    assert formatdup.collisions(keys.where("id < 3")).count() == 0


# ---- 3 quality
WORDS = {"en": "the of and to a in that is was for it with as on be".split()}
PROSE = "The house of that man was a good one. And it is for us to go on with. Is that as good? In a day it was on the way to be so. He was with it and that is that. As for the rest, it is in a box of the man on the hill."


SHAPES = [
    ("prose", PROSE),
    ("prose", "Call the man of it: - one is good.\nThe house was for us and that is it. " * 2 + "It is 5, 6 and 7."),
    ("list", "\n".join(f"- item {i} of it" for i in range(9))),
    ("list", "(a) of the house;\n(b) on it;\n(c) in that;\n(d) for us;"),
    ("list", "of | the | house | and so | more | last"),
    ("list", "about it: house, man, good, one, water, light, bread, fish"),
    ("table", "\n".join(f"a{i}\t{i * 7}\t{i}%\t-" for i in range(9))),
    ("table", "\n".join(f"| a{i} | {i * 7} | - |" for i in range(4))),
    ("table", "\n".join(f"a{i},{i * 7},{i}%" for i in range(9))),
    ("junk", " ".join(f"{i * 2654435761 % 2**32:08x}" for i in range(30))),
    ("junk", "very good price " * 30),
    ("junk", "the the the the the the the"),
    ("junk", "#$% =_= <*|* ~~^ %%& ##\\ $$ ^^"),
    ("junk", "<div class='a'><b>x</b></div>" * 9),
]


def test_kinds(spark):
    prose = [PROSE[k:] for k in range(60)]
    common = frame(spark, [("en", w) for w in WORDS["en"]], "lang string, word string")
    measured = quality.profiles(fields(spark, [t for _, t in SHAPES] + prose), common)
    held = quality.scales(measured)
    rows = measured.select("rec_id", quality.kind_of(quality.z_scores(held)).alias("kind")).collect()
    assert [r.kind for r in sorted(rows)] == [k for k, _ in SHAPES] + ["prose"] * 60
    # the sketches decide: with another spread of the same statistics other rows are in the tails
    wide = {lang: {s: (m, d * 4) for s, (m, d) in x.items()} for lang, x in held.items()}
    assert all(r.kind == "prose" for r in measured.select(quality.kind_of(quality.z_scores(wide)).alias("kind")).collect())
    assert quality.profiler(WORDS)("  \n") is None
    for t in HARD[3:]:
        quality.profiler(WORDS)(t)


def test_a_language_of_short_lines(spark):
    """A language whose prose is broken into short lines has a wider scale than one whose prose is not."""
    common = frame(spark, [("en", w) for w in WORDS["en"]] + [("te", "ఆ")], "lang string, word string")
    whole = "ఆ రైలు నగరం ఇల్లు నది వచ్చింది అక్కడ ఉంది.\nఒక చెట్టు పక్కన పిల్లలు ఆడుకున్నారు మరియు పాడారు.\nరాత్రి వాన పడింది కానీ పంట బాగుంది.\n"
    lines = [whole] * 200 + [whole + "ఆ నది పక్కన ఇల్లు\nమా ఊరు చాలా దూరం\nగాలి వాన మరియు ఎండ\nపంట పొలం దగ్గర\n"] * 20
    held = quality.scales(quality.profiles(fields(spark, [*lines, *[PROSE] * 200]), common))
    assert held["te"]["item_lines"][1] > 1.3 * held["en"]["item_lines"][1]


def test_small_languages_are_drawn_to_all(spark):
    common = frame(spark, [("en", w) for w in WORDS["en"]] + [("te", "ఆ")], "lang string, word string")
    few = quality.scales(quality.profiles(fields(spark, ["ఆ నది ఇల్లు రైలు"] + [PROSE] * 100), common))
    many = quality.scales(quality.profiles(fields(spark, ["ఆ నది ఇల్లు రైలు"] * 900 + [PROSE] * 100), common))
    own, other = 0.0, few["en"]["punctuated_lines"][0]
    assert other > 0.9 and abs(few["te"]["punctuated_lines"][0] - other) < 0.1 and many["te"]["punctuated_lines"][0] < 0.1 + own


def test_tails(spark):
    rnd = random.Random(5)
    vocabulary = WORDS["en"] + [f"word{c}" for c in "abcdefghij"]
    prose = [". ".join(" ".join(rnd.choices(vocabulary, k=9)).capitalize() for _ in range(6)) + "." for _ in range(120)]
    values = [*prose, "\n".join(f"- the {i} of it" for i in range(9)), None, " "]
    common = frame(spark, [("en", w) for w in WORDS["en"]] + [(None, "x"), ("en", None)], "lang string, word string")
    rows = {r.rec_id: r for r in quality.scored(quality.profiles(fields(spark, values, True), common)).collect()}
    assert rows[120].kind == "list" and rows[120].flagged and 121 not in rows and 122 not in rows
    assert all(rows[i].kind == "prose" for i in range(120))
    assert quality.scored(quality.profiles(fields(spark, []), common)).count() == 0


def test_thai_words_are_counted():
    p = quality.profiler({"th": ["ที่", "และ", "เป็น", "การ", "การที่"]})
    lang, words, length, *_ = p("บ้านที่ดีและ เป็นเมือง.")  # house|that|good|and, is|town.
    assert (lang, words, length) == ("th", 6, 22 / 6)
    share = list(quality.STATS).index("common_words") + 2
    assert p("บ้านที่ดีและ เป็นเมือง.")[share] == 3 / 6
    assert p("การที่และที่")[1:3] == (3, 4.0) and p("การที่และที่")[share] == 1.0
    assert p("บ้าน เมือง ดี ที่ -")[1] == 5 and p("บ้าน เมือง ดี ที่ -")[share] == 1 / 5


@pytest.mark.parametrize("n,lists", [(100, 40), (100, 90), (20, 8), (5, 5)])
def test_many_lists_in_one_language(spark, n, lists):
    rnd = random.Random(7)
    vocabulary = WORDS["en"] + [f"word{c}" for c in "abcdefghijklmnopqrstuvw"]
    entries = ["\n".join(" ".join(rnd.choices(vocabulary, k=3)) for _ in range(9)) for _ in range(lists)]
    prose = [". ".join(" ".join(rnd.choices(vocabulary, k=rnd.randrange(3, 14))).capitalize() for _ in range(6)) + "." for _ in range(n - lists)]
    records = [*entries, *prose]
    rows = quality.scored(quality.profiles(fields(spark, records), frame(spark, [("en", w) for w in WORDS["en"]], "lang string, word string"))).collect()
    assert {r.rec_id for r in rows if r.kind == "list"} == set(range(lists)) and {r.rec_id for r in rows if r.kind == "prose"} == set(range(lists, n))


# ---- 4 sentences
SENTENCES = [
    'He said, "Is it so?" |Then we left. |"No!" said he. |It cost approx. 5 for Dr. T. Rao vs. us, etc.',
    "A.B. was at 10.30 on 5.6.2001. |The U.S. man saw https://a.example/b.html today... but left. |So what?! |Yes",
    "తేదీ రూ. 38 గా ఉంది. |ఆయన అన్నారు, “వచ్చింది.” |నీరు 5 కి.మీ. దూరం. |“ఎవరు?” అని అన్నారు. |ఆ...ఇక్కడ ఉంది.|నగరం చూశాము.",
    "उसने कहा, “पढ़ा।” |ई.पू. 5 में। |“कौन?” ऐसा उसने कहा॥",
    "„Wer?“ sagte er. |Am 25. mai ging z.B. der Nr. 3. |« Que ? » dit-il. |Fin (oui !) du jour.",
    "我们走。|老人说：“好。”|「不。」他回答。|你？",
    "Heading\n\n|A line\nbreak goes on. |Next",
]


@pytest.mark.parametrize("case", SENTENCES)
def test_sentence_ends(case):
    parts = case.split("|")
    text, want = "", []
    for p in parts:
        text += p
        want.append(len(text.rstrip()))
    got = sentences.sentence_ends(text)
    a, out = 0, []
    for e in got:
        out.append(text[a:e])
        a = e
    assert got == want, out


def test_every_terminator_of_the_standard():
    import regex

    every = [c for c in map(chr, (*range(0xD800), *range(0xE000, 0x110000))) if regex.match(r"\p{Sentence_Break=STerm}", c)]
    assert len(every) > 150
    for c in every:
        text = f"aka ba{c} Tama na{c}"
        assert sentences.sentence_ends(text) == [7, len(text)], hex(ord(c))
    for text in ("မြန်မာစကား။ စာအုပ်တစ်အုပ်။", "ខ្ញុំទៅផ្សារ។ គាត់នៅផ្ទះ។", "ܫܠܡܐ܀ ܛܒܐ܀"):
        assert len(sentences.sentence_ends(text)) == 2


@pytest.mark.parametrize("depth", [1, 40, 3000])
def test_brackets_of_any_depth(depth):
    text = "He (" * depth + "no. Yes. " + ")" * depth + " went. Then we left."
    assert sentences.sentence_ends(text) == [len(text) - len(" Then we left."), len(text)]


def test_a_token_of_any_length():
    url = "https://a.example/" + "very-long-path/" * 20 + "page.Html"
    text = f"See {url} now. Then go."
    assert sentences.sentence_ends(text) == [text.index(" Then"), len(text)]
    assert len(sentences.sentence_ends("ที่ 5 นี่ บ้าน เมือง " * 3000)) > 3000


def test_sentences_cover_hard_texts():
    rnd = random.Random(7)
    alphabet = "aB .!?\"'“”(«)»\n।。…1ก ๆఅ్"
    for t in [*HARD[1:], *("".join(rnd.choices(alphabet, k=60)) for _ in range(400))]:
        began = time.time()
        ends = sentences.sentence_ends(t)
        assert ends == sorted(set(ends)) and all(t[e - 1 : e].strip() for e in ends)
        assert (ends[-1] if ends else 0) == len(t.rstrip()) and time.time() - began < 20


# ---- 5 languages
def test_labels():
    assert [langid.label_language(x) for x in ("te", "TEL", " te-IN", "Telugu", "zh_CN", "xx", "", None, "mul", "te in")] == ["te", "te", "te", "te", "zh", None, None, None, None, None]


def test_segments(spark):
    rnd = random.Random(3)
    vocab = {"en": "the house water table light word".split(), "de": "der die haus wasser tisch licht".split(), "te-Latn": "oka mariyu katha nadi illu".split(), "hi": "और यह घर पानी".split(), "mr": "आणि आहे घर पाणी".split()}
    rows = [(c.split("-")[0], " ".join(rnd.choices(w, k=40))) for c, w in vocab.items() for _ in range(30)]
    ref = frame(spark, [*rows, (None, "x"), ("en", None)], "lang string, text string")
    common = frame(spark, [("en", "the"), ("de", "der")], "lang string, word string")
    model = langid.fit(ref, "text", "lang", common, 10)
    cases = ["The house water word. Der tisch wasser licht die haus.", "ఒక రైలు the నగరం వచ్చింది. ఆ నది.", "oka katha nadi mariyu", "यह घर और पानी", None, "", "1 2 3", "<div><b></b></div>" * 20]
    df = frame(spark, [(i, t, "en", "clash") for i, t in enumerate(cases)], "rec_id bigint, t string, lang string, label string")
    seg = langid.segment_languages(df, "rec_id", "t", "lang", model, common)
    got = defaultdict(list)
    for r in seg.orderBy("rec_id", "start_pos").collect():
        got[r.rec_id].append(r.lang)
        assert 0 <= r.confidence <= 1 and r.start_pos < r.end_pos
    assert dict(got) == {0: ["en", "de"], 1: ["te"], 2: ["te"], 3: ["hi"]}
    assert {(r.rec_id, r.lang) for r in langid.unnamed_languages(seg).collect()} == {(0, "de"), (1, "te"), (2, "te"), (3, "hi")}
    assert {r.rec_id: r.lang for r in langid.document_languages(seg).collect()}[1] == "te"
    tag = langid.tagger(model)
    for t in HARD[1:]:
        tag(t)
    assert {x[2] for x in tag("მეორე დილით ბაზარში")} == {"und"}
    other = langid.segment_languages(frame(spark, [(1, "მეორე დილით ბაზარში წავედით.", None)], "rec_id bigint, t string, lang string"), "rec_id", "t", "lang", model, common)
    assert [r.lang for r in other.collect()] == ["und"] and langid.unnamed_languages(other).count() == 0


def test_words_of_no_language_of_the_model():
    rnd = random.Random(11)
    words = ["".join(rnd.choices("abcdefghilmno", k=rnd.randint(2, 7))) for _ in range(300)]
    model = langid.Model({"en": [" ".join(rnd.choices(words, k=400))], "de": [" ".join(rnd.choices(words[::-1][:100], k=400))]}, {})
    tag = langid.tagger(model)
    assert {x[2] for x in tag("zurw vyptu wrzkt trukw pyrtz.")} == {"und"} and {x[2] for x in tag(" ".join(words[:9]) + ".")} == {"en"}
    assert model.word("Latin", words[0])["en"] == 0.0 and model.word("Latin", "zurw")["und"] == 0.0 < model.word("Latin", "zurw")["en"]


def test_sample_of_the_model_is_bounded(spark):
    ref = spark.range(3000).selectExpr("if(id % 3 = 0, 'te', 'en') as lang", "concat('the house of that man is good and number ', id) as text")
    words = frame(spark, [("en", "the")], "lang string, word string")
    seen = {}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(langid, "Model", lambda samples, common: seen.update(samples))
        langid.fit(ref, "text", "lang", words, 40)
        first = dict(seen)
        langid.fit(ref.repartition(7), "text", "lang", words, 40)
    assert set(seen) == {"te-Latn", "en"} and all(30 <= len(t) <= 40 for t in seen.values()) and seen == first


def test_short_sentences_and_cells(spark):
    rnd = random.Random(3)
    vocab = {"en": "the house water table light word".split(), "de": "guten morgen haus wasser tisch licht".split()}
    ref = frame(spark, [(c, " ".join(rnd.choices(w, k=40))) for c, w in vocab.items() for _ in range(30)], "lang string, text string")
    common = frame(spark, [("en", "the"), ("de", "der")], "lang string, word string")
    tag = langid.tagger(langid.fit(ref, "text", "lang", common, 30))

    def held(text):
        return {lang for _, _, lang, _, whole in tag(text) if whole}

    telugu = "ఆయన ఇలా అన్నారు. {} ఒక రైలు నగరం వచ్చింది."
    assert held(telugu.format("Guten Morgen!")) == {"te", "de"}
    assert held(telugu.format("Morgen!")) == {"te"} and held("ఆయన guten morgen ఇలా అన్నారు.") == {"te"}
    pairs = [("ఇల్లు", "house"), ("నీరు", "water"), ("పదం", "word"), ("బల్ల", "table")]
    for sep in (" | ", "\t", " - ", ": ", "   "):
        assert held("\n".join(a + sep + b for a, b in pairs)) == {"te", "en"}, sep
    assert held("\n".join(f"{a} నది | {b} light" for a, b in pairs)) == {"te", "en"}
    assert held("\n".join(f"{a} | AB-{i}1" for i, (a, _) in enumerate(pairs))) == {"te"}


def test_junk_with_one_accent_has_no_language(spark):
    text = "xqzjv bcdfgh wxkzt pqrst vbnmk zxcvb qwrtp hjklm dfghj ptrsk mnbvc \xe9"
    common = frame(spark, [("en", "the"), ("de", "der")], "lang string, word string")
    measured = quality.profiles(fields(spark, [text]), common)
    assert [r.kind for r in quality.scored(measured).collect()] == ["junk"]
    ref = frame(spark, [(c, "the house water table light word and that is all " * 3) for c in ("en", "de")], "lang string, text string")
    df = frame(spark, [(1, text, "te")], "rec_id bigint, t string, lang string")
    assert langid.segment_languages(df, "rec_id", "t", "lang", langid.fit(ref, "text", "lang", common, 10), common).count() == 0


# ---- 6 terms
def test_terms_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(termfreq, "RUN_PAIRS", 5)  # many runs
    monkeypatch.setattr(termfreq, "_ROWS", 3)
    rnd = random.Random(4)
    values = [None, "", " ", "a a a\x1cb"] + [" ".join(rnd.choice("abcdefghijk") * rnd.randint(1, 3) for _ in range(rnd.randint(0, 9))) for _ in range(200)] + ["hot"] * 100
    df = frame(spark, [(i, v, 1) for i, v in enumerate(values)], "sent_id int, t string, records int").repartition(4)
    n, records = Counter(), Counter()
    for v in values:
        n.update((v or "").split())
        records.update(set((v or "").split()))
    holders = sum(bool((v or "").split()) for v in values)
    mark = lambda r: "rare" if r <= 2 else "common" if r >= 0.05 * holders else None
    got = {r.term: (r.occurrences, r.records, r.mark) for r in termfreq.marked_terms(df, "t").collect()}
    assert got == {t: (n[t], records[t], mark(records[t])) for t in n}
    assert termfreq.marked_terms(df.limit(0), "t").count() == 0


def test_terms_come_from_a_sort(spark):
    """Range exchange, sort and scanner stand in the plan that ran; nothing is hashed."""
    df = spark.range(500).selectExpr("concat_ws(' ', id % 7, 'hot', id) as t")
    found = termfreq.term_frequencies(termfreq.term_runs(df, "t"))
    assert found.count() == 501 and found.where("term = 'hot'").first().records == 500
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Sort [term") < plan.index("rangepartitioning(term") and "Aggregate" not in plan


def test_scanner_carries_terms_over_batches():
    import pyarrow as pa

    rnd = random.Random(1)
    rows = sorted((rnd.choice("abcde"), rnd.randint(1, 3), rnd.randint(1, 9)) for _ in range(60))
    for size in (1, 2, 7, 60):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + size])], names=termfreq._NAMES) for i in range(0, 60, size)]
        empty = batches[0].slice(0, 0)
        got = [tuple(r.values()) for b in termfreq.scan_sorted(iter([empty, *batches, empty])) for r in b.to_pylist()]
        assert got == [(t, sum(r for x, r, _ in rows if x == t), sum(n for x, _, n in rows if x == t)) for t in "abcde"]
    assert list(termfreq.scan_sorted(iter([]))) == []


# ---- 8 encoding
def test_encoding_round_trip(spark):
    ranks = encode.load_ranks(f"{encode.TOKENIZER_DIR}/{encode.VOCABULARY}")
    back = {v: k for k, v in ranks.items()}
    enc = encode.encoder()
    rnd = random.Random(6)
    for _ in range(200):
        w = bytes(rnd.choices(b"abcde \xe0\xb0\x95", k=rnd.randint(1, 400)))
        assert encode.merge_short(w, ranks) == encode.merge_long(w, ranks)
    for t in ["", "a <|endoftext|> b", "తెలుగు 🙂‍\x07", *HARD[3:]]:
        assert b"".join(back[i] for i in enc(t)).decode() == t
    df = frame(spark, [(1, None, 5), (2, "", 5), (3, "a b", 5)], "doc_id bigint, text string, ids int")
    assert {r.doc_id: r.ids for r in encode.encode_corpus(df, "doc_id", "text").collect()} == {1: [], 2: [], 3: enc("a b")}


def test_encoding_like_the_library():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{encode.TOKENIZER_DIR}/{encode.VOCABULARY}", "rb"))}
    lib = tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(8)
    enc = encode.encoder()
    for _ in range(300):
        t = "".join(rnd.choices("ab c's'll 12\n\t తెలుగు్é。🙂", k=60))
        assert enc(t) == lib.encode_ordinary(t)


# ---- 9 mixing
def test_mix(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join(["word"] * rnd.randint(1, 30)), rnd.choice([" A", "a", "b", "B ", "c", None, "other"]) if i > 40 else "rare", 1) for i in range(1500)]
    rows += [(9001, None, "a", 1), (9002, "", "b", 1), (rows[50][0], *rows[50][1:])]
    docs = frame(spark, rows, "doc_id bigint, text string, source string, h int")
    targets = frame(spark, [("A", 0.2, 1), ("b", 0.5, 3), ("rare", 0.2, 2), ("gone", 0.1, 2), (None, 0.3, 1), ("c", None, None)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(docs, targets)
    got = mixed.collect()
    held, used = Counter(), Counter()
    for r in got:
        held[r.source] += r.tokens
        used[r.source] += r.tokens * r.copies
    size = sum(held.values())
    caps = {"a": (0.2, 1), "b": (0.5, 3), "rare": (0.2, 2), "c": (0.0, 0)}
    assert set(held) == set(caps) and {r.source: max(x.copies for x in got if x.source == r.source) for r in got}["b"] <= 3
    for s, (w, cap) in caps.items():
        want = min(w * size, held[s] * cap)
        assert want - 31 <= used[s] <= want + 1, s  # one document short at most
    again = {(r.doc_id, r.copies) for r in mixing.mix(docs.repartition(7), targets).collect()}
    assert again == {(r.doc_id, r.copies) for r in got}
    shares = {r.source: r for r in mixing.mix_report(mixed, targets).collect()}
    # every source that could be filled takes what the others can't give
    filled = Counter()
    for r in mixing.mix(docs, targets, total_tokens=size // 2, redistribute=True).collect():
        filled[r.source] += r.tokens * r.copies
    assert size // 2 - 4 * 31 <= sum(filled.values()) <= size // 2 + 4 and filled["a"] <= held["a"] and filled["c"] == 0
    assert shares["gone"].tokens_used == 0 and abs(sum(r.actual_share for r in shares.values()) - 1) < 1e-9
    assert mixing.mix(docs.limit(0), targets).count() == 0 and mixing.mix(docs, targets.limit(0)).count() == 0


def test_wanted_tokens():
    have = {"a": 100, "b": 50, "c": 10}
    want = {"a": (0.5, 2), "b": (0.3, 1), "c": (0.2, 1)}
    assert mixing.wanted(want, have, 100, False) == {"a": 50, "b": 30, "c": 10}
    assert mixing.wanted(want, have, 100, True) == {"a": 56, "b": 34, "c": 10}  # 10 missing tokens, 5 to 3
    assert mixing.wanted(want, have, 1000, True) == {"a": 200, "b": 50, "c": 10}  # all caps reached
    assert mixing.wanted({"a": (0.0, 5)}, {"a": 3}, 10, True) == {"a": 0} and mixing.wanted({"a": (1.0, 2)}, {"a": 0}, 10, True) == {"a": 0}


def test_threshold_stops_at_one_hash(spark, monkeypatch):
    """Two levels are enough where a bucket of the second holds one hash; the result is that of all levels."""
    docs = frame(spark, [(i, "word " * (i % 7 + 1), "a") for i in range(300)], "doc_id bigint, text string, source string")
    targets = frame(spark, [("a", 0.4, 1)], "source string, target_share double, max_repeats int")
    levels = []
    cut_at = mixing._bucket
    monkeypatch.setattr(mixing, "_bucket", lambda level: levels.append(level) or cut_at(level))
    got = mixing.mix(docs, targets).collect()
    size = sum(r.tokens for r in got)
    used = sum(r.tokens * r.copies for r in got)
    assert max(levels) < 3 and 0.4 * size - 8 <= used <= 0.4 * size


# ---- 10 garbled text
def test_round_trips():
    plain = "“తెలుగు భాష” café – 30 °C und größer: नदी"
    for page in mojibake.PAGES:
        table = {b: c for c, b in mojibake.page_bytes(page).items()}
        garbled = "".join(table.get(b, chr(b)) for b in plain.encode())
        if all(b in table for b in plain.encode() if b > 127):
            assert mojibake.repair(f"sound. {garbled}") == (f"sound. {plain}", "restored"), page
    twice = plain.encode().decode("latin-1").encode().decode("latin-1")
    assert mojibake.repair(twice) == (plain, "restored")
    assert mojibake.repair("one day and two more of it".encode("utf-16-le").decode("utf-16-le")) == ("one day and two more of it", "sound")
    assert mojibake.repair(b"the small house on the hill ".decode("utf-16-le"))[1] == "restored"
    assert mojibake.repair("La lámpara más cara".encode("latin-1").decode("cp1251"))[0] == "La lámpara más cara"


def as_shown(text, page="cp1252"):
    table = {b: c for c, b in mojibake.page_bytes(page).items()}
    return "".join(table.get(b, chr(b)) for b in text.encode())


@pytest.mark.parametrize("times", [1, 2, 3, 4, 6])
@pytest.mark.parametrize("page", ["cp1252", "mac_roman", "cp437"])
def test_many_wrong_decodings(times, page):
    text = garbled = "“తెలుగు” café: नदी – größer"
    for _ in range(times):
        garbled = as_shown(garbled, page)
    assert mojibake.repair("A river. " + garbled) == ("A river. " + text, "restored")


@pytest.mark.parametrize("pages", [("cp1252", "mac_roman"), ("cp1251", "cp437"), ("cp437", "cp1252"), ("cp1252", "cp1251")])
def test_parts_in_two_pages(pages):
    a, b = "తెలుగు భాష నది", "नदी और घर"
    assert mojibake.repair(as_shown(a, pages[0]) + " and then " + as_shown(b, pages[1])) == (f"{a} and then {b}", "restored")
    twice = as_shown(as_shown(a, pages[0]), pages[0]) + " and then " + as_shown(as_shown(b, pages[1]), pages[1])
    assert mojibake.repair(twice) == (f"{a} and then {b}", "restored")


def test_a_lost_byte_costs_its_character():
    shown = as_shown("తెలుగు")
    gone = shown[:4] + "\ufffd" + shown[5:]
    assert mojibake.repair(gone) == ("త\ufffdలుగు", "lossy")
    assert mojibake.repair("caf\xc3\ufffd and \xc3\xa9t\xc3\xa9") == ("caf\ufffd and été", "lossy")


@pytest.mark.parametrize("shown,meant", [("He paid \u040850 for it.", "He paid £50 for it."), ("It is 30 \u2591C now", "It is 30 °C now"), ("they didn\xedt go", "they didn’t go"), ("a cup \u03a9 full", "a cup ½ full"), ("the \xecold mill\xee here", "the “old mill” here"), ("that \xf4so called\xf6 day", "that “so called” day")])
def test_single_signs_are_put_right(shown, meant):
    assert mojibake.repair(shown) == (meant, "restored")


def test_nothing_unchanged_is_called_restored():
    rnd = random.Random(12)
    alphabet = "aé\u0408\xec\xee\xf4\u2591\u03a9 1Cnt’“ÃÂ©\ufffd\x81€"
    for _ in range(4000):
        t = "".join(rnd.choices(alphabet, k=12))
        out, status = mojibake.repair(t)
        assert status != "restored" or out != t
        assert status != "sound" or out == t


@pytest.mark.parametrize("text", [None, "", " ", "SÃO JOÃO", "the “Â” key", "« Â »", "5 °C ¬ 10 m² ¼", "Ångström ÄÖÜ", "dit-il : “Écoute”", "«ÁÉÍÓÚ»", "తెలుగు", "你好，我们是村庄的成员。", "┌┬┐│└┴┘", "col·lecció"])
def test_sound_text_stays(text):
    assert mojibake.repair(text) == (text, "sound")


@pytest.mark.parametrize("sign", ["\U0001f600", "\u2192", "\u2713", "\u2714", "\u2605", "\u25ba", "\U0001f600\u2192", "\u2764\ufe0f", "\u0c05", "\u3002"])
@pytest.mark.parametrize("page", ["cp1252", "mac_roman", "cp437"])
def test_one_garbled_sign(sign, page):
    table = {b: c for c, b in mojibake.page_bytes(page).items()}
    shown = "".join(table[b] for b in sign.encode("utf-8"))
    assert mojibake.repair(f"all is well {shown} today") == (f"all is well {sign} today", "restored")


@pytest.mark.parametrize("text", ["\xabJe suis oubli\xe9\u2026\xbb", "\xab\xa0le caf\xe9\xa0\xbb", "\u0432\xa0\xab\u041c\u043e\u0441\u043a\u0432\u0435\xbb", "\u043d\u0430\u0434\u0456\u0457", "\u043b\u044e\u0431\u2026\xbb", "\u0442\u0430\u043c"])
def test_marks_after_a_letter_are_sound(text):
    assert mojibake.repair(text) == (text, "sound")


def test_lost_bytes(spark):
    df = frame(spark, [(1, "na�ve", 1), (2, "caf\x8e", 1), (3, "ok", 1), (4, None, 1)], "doc_id bigint, text string, status int")
    assert {r.doc_id: r.status for r in mojibake.repair_corpus(df, "doc_id", "text").collect()} == {1: "lossy", 2: "lossy", 3: "sound", 4: "sound"}
    for t in HARD[1:]:
        mojibake.repair(t)


def test_one_table_of_texts(spark):
    df = frame(spark, [(1, "a", "b")], "doc_id int, text string, field string")
    assert texts(df, "doc_id", "text", "text").columns == ["field", "rec_id", "text"]
