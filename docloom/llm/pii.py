"""Surrogates for personal data, in DataFrame expressions only.

Detection is one regular expression per row. Detected entities (type, canonical form) are gathered once for the whole corpus, duplicates
merged before the shuffle, and each gets a surrogate: a keyed hash of type, canonical form and attempt drives a replacement of the same type and
format (letters by letters of the same case and script, digits by digits, separators kept; card and IBAN check digits and addresses stay
valid, given names follow the gender of their title and the script; family names have endings that go with either gender, since one name
serves both). Collision checks run over the corpus: a surrogate that equals any detected original of its type, or another entity's surrogate, goes to the next
attempt, until none does, so distinct entities stay distinct. One entity has one surrogate wherever it stands, so
references stay linked: canonical forms ignore case (mail, names) and separators (phones, cards, IBANs).

A name is what follows a title: any number of capitalised words, with initials and particles (van, de la) before them. Its words are entities each, of one kind whatever their
title or place, so one word has one surrogate in the corpus; its gender and whether it is a given or a family name follow the most frequent of its titled places. Parts of hyphenated
words are words of their own, particles stay, and initials move to another letter by a shift that the key tells. A word that stands after a title is replaced in its whole text, with
title or without. After a title in capitals at most CAPITAL_WORDS words in capitals count, since a name can't be told from running capitals.

Numbers in the form of a card or an IBAN count only if their check digits fit, so order numbers and the like stay.

Plan: one pass finds the entities of every row and writes them with the row; rows without one pass through. References meet the surrogates in an
equi-join on the entity (a very common entity is a skewed key, which Spark splits), and their rows in one on the row's number.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise

# What is detected. Order decides where two could start at one place.
TITLES_M = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин"]
TITLES_F = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа"]
TITLES_ANY = ["Dr", "Prof", "Professor", "Доктор", "Профессор"]
TITLES = TITLES_M + TITLES_F + TITLES_ANY
# Words between a given and a family name, which are no names themselves.
PARTICLES = "von van vom zu zum zur af av de del della dello der den des di da do dos das du la las le los el al bin ibn ben ten ter te y e".split()
#: Titles that mean something else in capitals.
NOT_CAPITAL = ("Ms", "Sr")
CAPITALS = [t.upper() for t in TITLES if t not in NOT_CAPITAL]
CAPITAL_WORDS = 4
# Every pattern stands where no letter or digit is before it; START says so once for all.
START = r"(?<![\p{L}\p{N}])"
MAIL = r"(?<![._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++){1,20}"
SECRET = r"AKIA[0-9A-Z]{16}(?![\p{L}\p{N}])|[0-9a-f]{40}(?![\p{L}\p{N}])|(?<=[=:\s\"'])(?=[A-Za-z0-9_\-]{8})(?<=(?:password|passwd|token|secret|api_key)\s{0,3}[=:]\s{0,3}[\"']?)[A-Za-z0-9_\-]{8,}+"
IPV4 = r"(?<!\.)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?[\p{L}\p{N}])"
IPV6 = r"(?<![:.])(?=[0-9A-Fa-f:]*\d)(?=[0-9A-Fa-f:]{6})(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])"
IBAN = r"[A-Z]{2}\d{2}(?:(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![\p{L}\p{N}])"
SSN = r"(?<!-)\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])"
CARD = r"(?<![+.-])(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?![\p{L}\p{N}])"
# No group of a phone begins an address, nor, where the plan isn't known, a social security number or a card.
ADDRESS = r"(?!(?:\d{1,3}\.){3}\d)"
OTHER = ADDRESS + r"(?!\d{3}-\d{2}-\d{4}(?!\d)|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}(?![ -]?\d)|\d{4}[ -]\d{6}[ -]\d{5}(?!\d)|\d{13})"
# Digits of a full national number by country codes; a phone ends there, so a number after a blank is not part of it.
PLANS = {10: "1|7|30|44|52|90|91", 9: "31|33|34|40|41|46|48|61|351|380|420", 8: "45|47|65|852"}
NATIONAL = r"\+(?:" + "|".join(rf"(?:{codes})(?:[ .-]?\(0\))?(?:(?:(?:[ .-]|[ .-]?[()][ .-]?){ADDRESS})?\d){{{n}}}" for n, codes in PLANS.items()) + r")(?![\p{L}\p{N}])"
# Other plans: no group over a blank after five digits in a row or eleven in all; not ending inside a dotted or longer number, if it can be.
GROUPS = r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:(?:(?:[.-]|(?<!\d{5})(?<!" + r"\d[ .()-]{0,2}" * 10 + r"\d) )" + OTHER + r")?\d{2,4}){1,%d}(?![\p{L}\p{N}]%s)"
# Without a country code: three, three and four digits with one separator; a leading 0 with three groups, or in brackets.
LOCAL = r"(?<![.-])(?:\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|0\d{1,4} \d{3,4} \d{3,4}|\(0\d{1,5}\) ?\d{3,4}[ -]?\d{2,5})(?![\p{L}\p{N}]|[.-]\d)"
PHONE = NATIONAL + "|" + GROUPS % (4, r"|[.-]\d") + "|" + GROUPS % (3, "") + r"|\(\d{3}\) ?\d{3}-\d{4}(?![\p{L}\p{N}])" + "|" + LOCAL
WORD = r"\p{Lu}\p{L}*+(?:['’-]\p{L}{2,}+)*+(?!\p{N})"
TITLE = "(?:" + "|".join(TITLES + CAPITALS) + r")(?:\.(?= )|(?= ))"
INITIAL = r"\p{Lu}\."


def _name_pattern(titles: list[str], word: str, particles: list[str], repeat: str) -> str:
    """Titles, then words with initials and particles before them; no word is a title."""
    title = "(?:" + "|".join(titles) + r")(?:\.(?= )|(?= ))"
    between = "(?:" + "|".join(particles) + r")(?= )"
    return f"{title}(?: {title})*+(?:(?: (?:{INITIAL}|{between}))*+ (?!{title}){word}){repeat}"


CAPITAL_WORD = r"\p{Lu}{2,}+(?:['’-]\p{Lu}{2,}+)*+(?![\p{L}\p{N}])"
NAME = _name_pattern(TITLES, WORD, PARTICLES, "++") + "|" + _name_pattern(CAPITALS, CAPITAL_WORD, [p.upper() for p in PARTICLES], f"{{1,{CAPITAL_WORDS}}}+")
ENTITY = START + "(?:" + "|".join((MAIL, IBAN, SECRET, IPV6, IPV4, SSN, CARD, PHONE, NAME)) + ")"
#: A text without any of these has no entity: mail sign, digits, secrets' words and titles all hold one.
SIGN = "[@0-9]"
HINTS = ["passw", "token", "secret", "api_key", *(t for t in TITLES + CAPITALS if not any(t != other and other in t for other in TITLES + CAPITALS))]

# Alphabets (first and last code point, letters) and syllables of surrogates, by script.
ALPHABETS = [
    (0x61, 0x7A, "abcdefghijklmnopqrstuvwxyz"),
    (0x41, 0x5A, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (0x30, 0x39, "0123456789"),
    (0x430, 0x44F, "абвгдежзиклмнопрстуфхцчшэюя"),
    (0x410, 0x42F, "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"),
    (0x3B1, 0x3C9, "αβγδεζηθικλμνξοπρστυφχψω"),
    (0x4E00, 0x9FFF, "安白成大方高国海和金开林明南平青山石文新"),
]
SYLLABLES = {"latin": "ba be bo da de do fa ga ge ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se ta te to va", "cyrillic": "ба бе бо ва да де до за ка ко ла ле ло ма ме мо на не но па по ра ре ро са се та те то фа ша ха"}
#: Attempts from which surrogates of small spaces grow longer than their originals.
LONGER = 4
ENDINGS = {"latin": {"m": "n r s l", "f": "na ra la ia", "u": "en is am el", "x": "man ford ley well"}, "cyrillic": {"m": "н р с л", "f": "на ра ла ия", "u": "ан ей ай ен", "x": "ко дзе их ук"}}


def _byte(i: Column | int) -> Column:
    """Byte i (from 0, modulo 32) of the row's hash, in column bytes."""
    at = F.lit(i) if isinstance(i, int) else i
    return F.element_at("bytes", F.pmod(at, F.lit(32)) + 1)


def _pick(values: Column, i: int) -> Column:
    return F.element_at(values, F.pmod(_byte(i) * 7 + _byte(i + 11), F.size(values)) + 1)


def _masked(text: Column, hex_digits: Column) -> Column:
    """text with every letter and digit replaced by one of its own class, driven by column bytes; other characters stay."""

    def one(i: Column) -> Column:
        c = F.substr(text, i, F.lit(1))
        code, n = F.ascii(c), _byte(i) + F.pmod(F.floor(i / 32).cast("int") * 7 + _byte(i + 13), F.lit(256))
        letter = lambda letters: F.substr(F.lit(letters), F.pmod(n, F.lit(len(letters))) + 1, F.lit(1))
        out = F.when(hex_digits & (code.between(0x30, 0x39) | code.between(0x61, 0x66)), letter("0123456789abcdef"))
        for low, high, letters in ALPHABETS:
            out = out.when(code.between(low, high), letter(letters))
        return out.when((code < 128) | c.rlike(r"^\P{L}$"), c).otherwise(letter(ALPHABETS[0][2]))

    return F.when(F.length(text) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), one), "")).otherwise(text)


def luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of a digit string (0: valid)."""
    n = F.length(digits)

    def term(i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(F.pmod(n - i, F.lit(2)) == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.pmod(F.aggregate(F.transform(F.sequence(F.lit(1), n), term), F.lit(0), lambda a, x: a + x), F.lit(10))


def mod97(characters: Column) -> Column:
    """Remainder modulo 97 of a string of digits and capitals, A being 10."""

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.pmod(F.when(code < 58, acc * 10 + code - 48).otherwise(acc * 100 + code - 55), F.lit(97))

    return F.aggregate(F.split(characters, ""), F.lit(0), step)


def _name() -> Column:
    cyrillic = F.col("canon").rlike(r"^\p{IsCyrillic}")
    either = lambda f: F.when(cyrillic, F.split(F.lit(f("cyrillic")), " ")).otherwise(F.split(F.lit(f("latin")), " "))
    syllables = either(lambda script: SYLLABLES[script])
    ending = either(lambda s: ENDINGS[s]["x"])
    for style in "mfu":
        ending = F.when(F.col("style") == style, either(lambda s, style=style: ENDINGS[s][style])).otherwise(ending)
    return F.concat(*(_pick(syllables, i) for i in (0, 2, 4)), F.when(F.col("attempt") > 1, _pick(syllables, 6)).otherwise(""), _pick(ending, 8))


def _longer(letters: str, since: int) -> Column:
    """From attempt since on, as many further letters as attempts since then: the space of surrogates grows tenfold or more a round."""
    more = lambda i: F.substr(F.lit(letters), F.pmod(_byte(i * 5 + 3) + _byte(i + 17), F.lit(len(letters))) + 1, F.lit(1))
    return F.when(F.col("attempt") >= since, F.array_join(F.transform(F.sequence(F.lit(since), F.col("attempt")), more), "")).otherwise("")


def proposed(entities: DataFrame, key: str) -> DataFrame:
    """entities(kind, canon, style, attempt) with new: the surrogate, in canonical form, for an attempt number (from 0).

    Hash, bytes and masked part are columns of their own, so each is computed once a row.
    """
    kind, canon, attempt = F.col("kind"), F.col("canon"), F.col("attempt")
    seeded = entities.withColumn("seed", F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, attempt.cast("string")), 256))
    seeded = seeded.withColumn("bytes", F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substr("seed", 1 + 2 * i, F.lit(2)), 16, 10).cast("int")))
    # What stays in front, and what is masked.
    front = (
        F.when(kind == "card", F.substr(canon, F.lit(1), F.lit(1)))
        .when(kind == "iban", F.substr(canon, F.lit(1), F.lit(2)))
        .when(kind == "phone", F.regexp_extract(canon, r"^(\+1|\+\d{2}|0|)", 1))
        .when((kind == "secret") & canon.startswith("AKIA"), "AKIA")
        .otherwise("")
    )
    part = (
        F.when(kind == "mail", F.split_part(canon, F.lit("@"), F.lit(1)))
        .when(kind == "card", F.substr(canon, F.lit(2), F.length(canon) - 2))
        .when(kind == "iban", F.substr(canon, F.lit(5)))
        .otherwise(F.substr(canon, F.length("front") + 1))
    )
    parted = seeded.withColumn("front", front).withColumn("part", part)
    parted = parted.withColumn("mask", _masked(F.col("part"), (kind == "ip6") | ((kind == "secret") & canon.rlike("^[0-9a-f]+$"))))
    end = F.regexp_extract(canon, r"\.(com|org|net)$", 1)
    mail = F.concat("mask", F.lit("@mail"), F.pmod(_byte(29), F.lit(100)).cast("string"), _longer("0123456789", 1), F.lit(".example."), F.when(end == "", F.lit("com")).otherwise(end))
    address = F.concat_ws(".", *(o.cast("string") for o in (F.when(attempt < 8, 240 + F.pmod(_byte(0), F.lit(15))).otherwise(1 + F.pmod(_byte(0), F.lit(223))), _byte(1), _byte(2), _byte(3))))
    last = F.pmod(10 - luhn(F.concat("front", "mask", F.lit("0"))), F.lit(10))
    check = F.lpad((98 - mod97(F.concat("mask", "front", F.lit("00")))).cast("string"), 2, "0")
    area = F.concat((2 + F.pmod(_byte(30), F.lit(8))).cast("string"), F.substr("mask", F.lit(2)))
    fiction = (F.length("part") == 10) & (attempt < 8) & (F.substr("part", F.lit(4), F.lit(3)) == "555")
    phone = F.concat("front", F.when(fiction, F.concat((2 + F.pmod(_byte(30), F.lit(8))).cast("string"), F.substr("mask", F.lit(2), F.lit(2)), F.lit("555"), F.substr("mask", F.lit(7)))).otherwise(area))
    new = F.when(kind == "mail", mail).when(kind == "ip", address).when(kind == "card", F.concat("front", "mask", last.cast("string"))).when(kind == "iban", F.concat("front", check, "mask")).when(kind == "phone", phone)
    new = new.when((kind == "name") & canon.rlike(r"^[\p{IsCyrillic}\p{IsLatin}]"), _name()).otherwise(F.concat("front", "mask"))
    # Cards and IBANs keep their length (their space is large), IPv4 addresses theirs; a short IPv6 address gets another group.
    group = F.concat(F.lit(":"), F.substring("seed", 5, 4))
    new = F.when((kind == "ip6") & (attempt >= LONGER) & (F.size(F.split(canon, ":")) < 8), F.concat(new, group)).otherwise(new)
    name_more = F.when(canon.rlike(r"^\p{IsCyrillic}"), _longer(ALPHABETS[3][2], LONGER)).otherwise(_longer(ALPHABETS[0][2], LONGER))
    new = F.when(kind.isin("phone", "ssn", "secret"), F.concat(new, _longer("0123456789", LONGER))).when(kind == "name", F.concat(new, name_more)).otherwise(new)
    return parted.withColumn("new", F.when(kind.isin("name", "mail"), F.lower(new)).otherwise(new)).select(*entities.columns, "new")


def kind_of(raw: Column) -> Column:
    """Type of a whole match; null for a number whose check digits do not fit."""
    full = lambda p: raw.rlike(f"^(?:{p})$")
    digits = F.regexp_replace(raw, "[^0-9]", "")
    return (
        F.when(raw.contains("@"), "mail")
        .when(raw.rlike(rf"^{TITLE} "), "name")
        .when(full(IBAN), F.when(_iban(raw), "iban"))
        .when(raw.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
        .when(raw.rlike("^[0-9A-Fa-f]*:[0-9A-Fa-f:]+$"), "ip6")
        .when(full(r"\d{3}-\d{2}-\d{4}"), "ssn")
        .when(raw.rlike(r"^[+(]") | full(LOCAL), "phone")
        .when(raw.rlike("^[0-9 -]+$") & F.length(digits).between(13, 19), F.when(luhn(digits) == 0, "card"))
        .otherwise("secret")
    )


def _iban(raw: Column) -> Column:
    bare = F.regexp_replace(raw, " ", "")
    return mod97(F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))) == 1


#: An entity in a match: what stands between it and the one before, and for names in titled places the style: m, f, u (given names) or x (family name).
PART = "struct<kind:string,canon:string,raw:string,sep:string,style:string>"


def _part(kind: Column, canon: Column, raw: Column, sep: Column, style: Column) -> Column:
    return F.struct(kind.cast("string").alias("kind"), canon.cast("string").alias("canon"), raw.alias("raw"), sep.alias("sep"), style.cast("string").alias("style"))


def _name_parts(raw: Column) -> Column:
    """The words of a name with titles; titles, particles and initials have kind null. The last word, with all its hyphened parts, is the family name."""
    words = F.split(raw, " ")
    bare = lambda w: F.upper(F.rtrim(w, F.lit(".")))
    says = lambda titles: F.exists(words, lambda w: bare(w).isin([t.upper() for t in titles]))
    gender = F.when(says(TITLES_M), "m").when(says(TITLES_F), "f").otherwise("u")
    none = F.lit(None)

    def word(w: Column, i: Column) -> Column:
        style = F.when(i == F.size(words) - 1, "x").otherwise(gender)
        before = lambda j: F.when(j > 0, "-").when(i > 0, " ").otherwise("")
        stays = bare(w).isin([t.upper() for t in TITLES]) | F.lower(w).isin(PARTICLES) | w.rlike(f"^{INITIAL}$")
        return F.when(stays, F.array(_part(none, none, w, before(F.lit(0)), none))).otherwise(F.transform(F.split(w, "-"), lambda p, j: _part(F.lit("name"), F.lower(p), p, before(j), style)))

    return F.flatten(F.transform(words, word))


def _parts(raw: Column, names: Column) -> Column:
    """The entities of a match, a kind null staying as it is. names: the text's names, which count without a title too."""
    kind, none = kind_of(raw), F.lit(None)
    canon = F.when(kind.isin("mail", "ip6"), F.lower(raw)).when(kind.isin("card", "phone"), F.regexp_replace(raw, "[^0-9+]", "")).when(kind == "iban", F.regexp_replace(raw, " ", "")).otherwise(raw)
    known = F.exists(names, lambda p: p["canon"] == F.lower(raw))
    single = F.when(known, _part(F.lit("name"), F.lower(raw), raw, F.lit(""), none)).otherwise(_part(kind, canon, raw, F.lit(""), none))
    return F.when(kind == "name", _name_parts(raw)).otherwise(F.array(single))


def styled(seen: DataFrame) -> DataFrame:
    """(kind, canon, style) of every entity of seen(kind, canon, style): a name that is mostly a family name is one (x), else its gender is that of most of its titles (u for neither)."""
    votes = seen.groupBy("kind", "canon").agg(*[F.count_if(F.col("style") == v).alias(v) for v in "mfux"])
    style = F.when(F.col("x") > F.col("m") + F.col("f") + F.col("u"), "x").when(F.col("m") > F.col("f"), "m").when(F.col("f") > F.col("m"), "f").otherwise("u")
    return votes.select("kind", "canon", F.when(F.col("kind") == "name", style).alias("style"))


def shifted(raw: Column, key: str) -> Column:
    """An initial with another letter of its alphabet, by a shift that the key tells; other scripts stay."""
    out = raw
    for _, _, letters in (ALPHABETS[1], ALPHABETS[4]):
        shift = 1 + int(hashlib.sha256(f"{key}:initials".encode()).hexdigest(), 16) % (len(letters) - 1)
        moved = F.translate(raw, letters, letters[shift:] + letters[:shift])
        out = F.when(F.translate(F.substr(raw, F.lit(1), F.lit(1)), letters, "") == "", moved).otherwise(out)
    return out


def detected(rows: DataFrame, text: Column) -> DataFrame:
    """rows with parts (of every match in order, its entities) and pattern (what found them); both null where there is none.

    A text with titled names is searched once more, with these names as further alternatives.
    """
    hint = text.rlike(SIGN)
    for word in HINTS:
        hint = hint | text.contains(word)
    once = rows.withColumn("first", F.when(hint, F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))))
    titled = F.flatten(F.transform(F.filter("first", lambda m: m.rlike(rf"^{TITLE} ")), _name_parts))
    named = once.withColumn("names", F.coalesce(F.filter(titled, lambda p: p["kind"].isNotNull()), F.array().cast(f"array<{PART}>")))
    bare = F.array_join(F.array_distinct(F.flatten(F.transform("names", lambda p: F.array(p["raw"], F.upper(p["raw"]))))), "|")
    pattern = F.when(F.size("names") > 0, F.concat(F.lit(ENTITY + "|" + START + "(?:"), bare, F.lit(r")(?![\p{L}\p{N}])"))).otherwise(F.lit(ENTITY))
    both = named.withColumn("pattern", F.when(F.size("first") > 0, pattern))
    found = both.withColumn("found", F.when(F.size("names") > 0, F.regexp_extract_all(text, F.col("pattern"), F.lit(0))).when(F.size("first") > 0, F.col("first")))
    return found.withColumn("parts", F.transform("found", lambda raw: _parts(raw, F.col("names")))).drop("first", "names", "found")


def formatted(kind: Column, raw: Column, new: Column) -> Column:
    """A canonical surrogate in the format of the raw entity: separators of phones and cards, capitals of mail and names."""

    def put(acc: Column, c: Column) -> Column:
        digit = c.rlike("^[A-Za-z0-9+]$")
        return F.struct(F.concat(acc["t"], F.when(digit, F.substr(new, acc["i"], F.lit(1))).otherwise(c)).alias("t"), (acc["i"] + F.when(digit, 1).otherwise(0)).alias("i"))

    spaced = F.aggregate(F.split(raw, ""), F.struct(F.lit("").alias("t"), F.lit(1).alias("i")), put, lambda acc: F.concat(acc["t"], F.substr(new, acc["i"])))
    name = F.when(F.length(raw) > 1, F.when(F.upper(raw) == raw, F.upper(new)).otherwise(F.initcap(new))).otherwise(F.upper(new))
    return F.when(kind.isin("phone", "card", "iban"), spaced).when(kind == "name", name).when(kind.isin("mail", "ip6") & (F.upper(raw) == raw) & (F.lower(raw) != raw), F.upper(new)).otherwise(new)


def surrogates(spark: SparkSession, entities: DataFrame, key: str, rounds: int = 40) -> DataFrame:
    """(kind, canon, new) of distinct entities(kind, canon) with their style, if there is one; new is distinct within a kind and equals no original of it.

    Mail domains grow with the attempt, short phones, numbers, secrets and names from attempt LONGER on, so their space is not exhausted. Raises
    RuntimeError if collisions remain after the given rounds: only cards and addresses have a fixed space.
    """
    style = F.max("style") if "style" in entities.columns else F.lit(None).cast("string")
    mine = materialise(spark, entities.groupBy("kind", "canon").agg(style.alias("style")))
    originals = mine.select("kind", F.col("canon").alias("new"), F.lit(True).alias("taken"))
    kept = None
    left = mine.select("kind", "canon", "style", F.lit(0).alias("attempt"))
    for _ in range(rounds):
        tried = materialise(spark, proposed(left, key))
        first = tried.groupBy("kind", "new").agg(F.min("canon").alias("owner"))
        checked = tried.join(first, ["kind", "new"]).join(originals, ["kind", "new"], "left")
        if kept is not None:
            checked = checked.join(kept.select("kind", "new", F.lit(True).alias("used")), ["kind", "new"], "left")
        else:
            checked = checked.withColumn("used", F.lit(None).cast("boolean"))
        good = (F.col("owner") == F.col("canon")) & F.col("taken").isNull() & F.col("used").isNull()
        checked = materialise(spark, checked.select("kind", "canon", "style", "attempt", "new", good.alias("good")))
        now = checked.filter("good").select("kind", "canon", "new")
        kept = now if kept is None else kept.unionByName(now)
        left = checked.filter("not good").select("kind", "canon", "style", (F.col("attempt") + 1).alias("attempt"))
        if left.isEmpty():
            return kept
    raise RuntimeError("surrogates still collide")


def pseudonymise(spark: SparkSession, docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with every detected entity of the text column replaced; all columns and rows kept, null and empty texts as they are.

    Rows of equal text are treated alike. Extra columns pass through, whatever their names.
    """
    packed = docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = detected(packed, F.col("row")[text]).withColumn("some", F.coalesce(F.exists("parts", lambda p: F.exists(p, lambda e: e["kind"].isNotNull())), F.lit(False)))
    found = materialise(spark, found)
    clean = found.filter("not some").select("row.*")
    hit = found.filter("some")
    seen = hit.select("rid", F.posexplode("parts").alias("pos", "part")).select("rid", "pos", F.posexplode("part").alias("sub", "e")).select("rid", "pos", "sub", "e.*")
    known = surrogates(spark, styled(seen.filter("kind is not null")), key)
    stays = F.when(F.col("raw").rlike(f"^{INITIAL}$"), shifted(F.col("raw"), key)).otherwise(F.col("raw"))
    new = F.coalesce(formatted(F.col("kind"), F.col("raw"), F.col("new")), stays)
    # What stays as it is joins nothing; it keeps keys that spread.
    joined = seen.withColumn("canon", F.coalesce("canon", F.concat(F.lit("\x00"), F.col("rid").cast("string")))).withColumn("kind", F.coalesce("kind", F.lit(""))).join(known, ["kind", "canon"], "left")
    whole = joined.select("rid", F.struct("pos", "sub", "sep", new.alias("new")).alias("p")).groupBy("rid").agg(F.array_sort(F.collect_list("p")).alias("p"))

    def glue(acc: Column, p: Column) -> Column:
        return F.when(p["sub"] == 0, F.concat(acc, F.array(p["new"]))).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), p["sep"], p["new"]))))

    subs = whole.select("rid", F.aggregate("p", F.array().cast("array<string>"), glue).alias("subs"))
    between = F.split(F.col("row")[text], F.col("pattern"), -1)
    mended = F.concat(F.element_at("between", 1), F.array_join(F.zip_with("subs", F.slice("between", 2, F.size("between")), lambda s, b: F.concat(s, b)), ""))
    out = hit.select("rid", "row", between.alias("between")).join(subs, "rid").select("row", mended.alias("mended"))
    out = out.select(*[F.col("mended").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
    return clean.unionByName(out)
