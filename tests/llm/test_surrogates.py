"""Surrogates against planted entities: detection, format, distinctness, coreference, and what must stay."""

import random
import re

from docloom.llm import pii

SHAPES = [
    ("mail", lambda r: f"{r.choice('abcdef')}{r.randrange(10**4)}@host{r.randrange(50)}.com"),
    ("ip", lambda r: ".".join(str(r.randrange(1, 255)) for _ in range(4))),
    ("ip6", lambda r: ":".join(f"{r.randrange(1, 1 << 16):x}" for _ in range(8))),
    ("ip6", lambda r: f"2001:db8::{r.randrange(1, 1 << 16):x}"),
    ("phone", lambda r: f"+1 ({r.randrange(200, 999)}) 555-{r.randrange(10**4):04d}"),
    ("phone", lambda r: f"{r.randrange(200, 999)}-{r.randrange(200, 999)}-{r.randrange(10**4):04d}"),
    ("phone", lambda r: f"020 {r.randrange(10**3, 10**4)} {r.randrange(10**3, 10**4)}"),
    ("ssn", lambda r: f"{r.randrange(100, 999)}-{r.randrange(10, 99)}-{r.randrange(10**3, 10**4)}"),
    ("card", lambda r: card(r, 15)),
    ("iban", lambda r: iban(r)),
    ("secret", lambda r: "".join(r.choices("0123456789abcdef", k=40))),
]


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10


def card(r, n):
    body = "4" + "".join(r.choices("0123456789", k=n - 1))
    return next(body + str(d) for d in range(10) if luhn(body + str(d)) == 0)


def remainder(x):
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97


def iban(r):
    body = "".join(r.choices("0123456789", k=18))
    bare = f"DE{98 - remainder('DE00' + body):02d}{body}"
    return " ".join(bare[i : i + 4] for i in range(0, 22, 4)) if r.random() < 0.5 else bare


def run(spark, texts, key="k"):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pii.pseudonymise(spark, rows, key).orderBy("doc_id").collect()]


def test_planted_entities(spark):
    """Filler stays word by word; every entity changes, keeps its shape, and maps one to one over the corpus."""
    r = random.Random(7)
    pool = [(kind, make(r)) for kind, make in SHAPES for _ in range(12)]
    texts, plans = [], []
    for _ in range(60):
        plan = [r.choice(pool) if r.random() < 0.3 else (None, r.choice(["see", "the", "17", "note,", "of", "3.5", "x_y"])) for _ in range(r.randrange(1, 25))]
        plans.append(plan)
        texts.append(" | ".join(x for _, x in plan))
    out, new = run(spark, texts), {}
    for plan, text in zip(plans, out, strict=True):
        for (kind, old), got in zip(plan, text.split(" | "), strict=True):
            if kind is None:
                assert got == old
            else:
                assert got != old and new.setdefault((kind, old.replace(" ", "") if kind == "iban" else old), got).replace(" ", "") == got.replace(" ", "")
                shape = lambda x: re.sub(r"[a-z]", "a", re.sub(r"[0-9]", "0", x))
                if kind in ("phone", "ssn", "card"):
                    assert shape(got) == shape(old)
                if kind == "card":
                    assert luhn(got) == 0
                if kind == "iban":
                    assert remainder(got.replace(" ", "")) == 1 and got[:2] == "DE"
    assert len({(k, v.replace(" ", "")) for (k, _), v in new.items()}) == len(new)
    assert not {v for _, v in new} & set(new.values())
    assert run(spark, texts) == out and run(spark, texts, "other") != out


def test_names_are_linked_through_a_text(spark):
    texts = [
        "Herr Karl Schmidt came. Schmidt left. Karl Schmidt wrote to karl@x.de. SCHMIDT'S dog.",
        "Dr. Anna Weber and Prof. Dr. Weber met Frau Weber; Weber's idea. Anna said so.",
        "Herr Dr. Karl Meyer. Schmidt is no name here.",
        "Mr. O'Brien, Mrs Smith-Jones. O'Brien and Smith-Jones.",
        "Господин Иван Петров пришёл. Петров ушёл.",
    ]
    a, b, c, d, e = run(spark, texts)
    for text, gone in ((a, "Karl Schmidt SCHMIDT karl"), (b, "Anna Weber"), (c, "Karl Meyer"), (d, "O'Brien Smith-Jones"), (e, "Иван Петров")):
        assert not [w for w in gone.split() if w in text]
    given, family = re.match(r"Herr (\w+) (\w+) came", a).groups()
    assert f"{family} left. {given} {family} wrote to " in a and f"{family.upper()}'S dog" in a
    anna, weber = re.match(r"Dr\. (\w+) (\w+) and", b).groups()
    assert b == f"Dr. {anna} {weber} and Prof. Dr. {weber} met Frau {weber}; {weber}'s idea. {anna} said so."
    assert c.startswith(f"Herr Dr. {given} ") and c.endswith("Schmidt is no name here.")
    assert re.fullmatch(r"Господин [а-яА-Я]+ ([а-яА-Я]+) пришёл\. \1 ушёл\.", e)


def test_what_stays(spark):
    stays = ["order 5927243074273351 of 12", "DE00 1234 5678 9012 3456 78", "at 12:30:45 and 1:2", "std::vector and a::b", "v1.2.3 of 300.1.2.3", "Herr und Frau kamen", "Dr No1 and Mr", None, "", "123-456", "Karl Schmidt"]
    assert run(spark, stays) == stays


def test_long_names_initials_and_particles(spark):
    texts = [
        "Dr Maria Anna Luisa Elena Weber came. Weber and Luisa left.",
        "Mr J. Smith met Mr. J. K. Smith. Plan J is on, J. too.",
        "Dr Ludwig van Beethoven; Ms. de Souza and Herr von Braun. Frau Ana de la Cruz spoke.",
        "MR JOHN SMITH and HERR VON BRAUN. MS OFFICE, DR NO1.",
        "Frau Anna-Maria Schmidt-Jones. Anna-Maria came, Maria too.",
        "Frau Weber Herr Braun",
    ]
    out = run(spark, texts)
    gone = ["Maria Anna Luisa Elena Weber", "Smith", "Ludwig Beethoven Souza Braun Ana Cruz", "JOHN SMITH BRAUN", "Anna Maria Schmidt Jones", "Weber Braun"]
    for text, words in zip(out, gone, strict=True):
        assert not [w for w in words.split() if w in text], text
    word = r"([^\W\d_]+)"
    a = re.fullmatch(rf"Dr {word} {word} {word} {word} {word} came\. {word} and {word} left\.", out[0])
    assert a and a[6] == a[5] and a[7] == a[3] and len(set(a.groups())) == 5
    b = re.fullmatch(rf"Mr ([A-Z])\. {word} met Mr\. ([A-Z])\. ([A-Z])\. {word}\. Plan J is on, J\. too\.", out[1])
    assert b and b[1] == b[3] != "J" and b[4] not in ("K", b[3]) and b[2] == b[5]
    c = re.fullmatch(rf"Dr {word} van {word}; Ms\. de {word} and Herr von {word}\. Frau {word} de la {word} spoke\.", out[2])
    assert c and len(set(c.groups())) == 6
    d = re.fullmatch(rf"MR {word} {word} and HERR VON {word}\. MS OFFICE, DR NO1\.", out[3])
    assert d and d[2] == b[2].upper() and d[3] == c[4].upper()
    e = re.fullmatch(rf"Frau {word}-{word} {word}-{word}\. {word}-{word} came, {word} too\.", out[4])
    assert e and e[5] == e[1] and e[6] == e[7] == e[2] == a[1] and e[1] == a[2]
    assert out[5] == f"Frau {a[5]} Herr {c[4]}"


def test_one_surrogate_for_a_word_over_titles_and_places(spark):
    """Titles of a person vary, given names stand alone, and one word is a given and a family name; distinct over all names."""
    texts = ["Mr John Smith met Dr John Smith.", "Mr Peter came. Mr Peter Jones came.", "Frau Jones Peter.", "Dr Kim Lee, Prof Kim Lee.", "Frau Kim Stone. Frau Eva Peter. Herr Paul Eva."]
    texts += [f"Mr Alb{chr(97 + i % 26)}{chr(97 + i // 26)}o Cor{chr(97 + i % 26)}{chr(97 + i // 26)}a" for i in range(300)]
    out, new = run(spark, texts), {}
    titles = {*pii.TITLES, "met", "came"}
    for before, after in zip(texts, out, strict=True):
        for old, got in zip(re.findall(r"\w+", before), re.findall(r"\w+", after), strict=True):
            if old in titles:
                assert got == old
            else:
                assert new.setdefault(old, got) == got != old
    assert len(set(new.values())) == len(new) and not set(new) & set(new.values())
    ending = lambda w, style: any(new[w].endswith(e) for e in pii.ENDINGS["latin"][style].split())
    assert ending("John", "m") and ending("Smith", "x") and ending("Kim", "f") and ending("Lee", "x")
