"""PII: surrogate generation, in DataFrame operations only.

Detected entities (e-mail addresses, telephone, card, account (IBAN) and social security numbers, IPv4 and IPv6 addresses,
names after a form of address or with a usual first name, and the family names of those wherever they stand in the same
text) are replaced by keyed surrogates of the same type. An entity's canonical form (lower case, digits only ...) and a
secret key give a SHA-256; its digits drive the surrogate, which is then laid out in the mention's own format. So one
entity has one surrogate in all documents, however it is written (coreference), and a surrogate keeps the type, the
script, the gender, the letters' case, the separators, and check digits that are right.

A name of two words is two entities: its family name, which has one surrogate whoever bears it and under whichever form,
and the person, whose first name is drawn anew. Some written forms show a trait (a person's gender, the length of a
telephone number's country code), others do not: a mention without it takes the entity's, the smallest of all its
mentions. A name under forms of both genders is two people, each with a first name of the own gender; the other mentions
are of the first. Where no mention shows a gender, a usual first name does, else the hash decides.

Collision check: all distinct entities, in each of their traits, are gathered once; where two share a surrogate (two
people: with one family name), or a surrogate is an entity of the corpus, all but the smallest entity take another
attempt, until none collide. Later attempts draw addresses and names from larger spaces, so rounds end; numbers of a
fixed length can run out, so from round ``FREE`` on a surrogate may be a number of the corpus, and after ``MOST`` rounds
the run fails. Only entities of another attempt, and those whose mentions differ in their trait, need a table; the
others' surrogates follow from the mention alone, so texts without them are rewritten where they lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.llm.common import cut, forget, unused

#: Forms of address by gender, first names by gender and script, syllables of family names by script.
MALE_FORMS = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "г-н", "Господин")
FEMALE_FORMS = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "г-жа", "Госпожа")
OTHER_FORMS = ("Dr", "Prof")
MALE = ("Adam", "Albert", "Bruno", "Carl", "Daniel", "David", "Emil", "Felix", "Frank", "Hugo", "Ivan", "Jonas", "Leon", "Lucas", "Martin", "Max", "Oscar", "Paul", "Simon", "Victor")
FEMALE = ("Alice", "Anna", "Clara", "Diana", "Elena", "Emma", "Eva", "Greta", "Helena", "Irene", "Julia", "Laura", "Lena", "Maria", "Marta", "Nina", "Olga", "Paula", "Rosa", "Sofia")
MALE_CYRILLIC = ("Андрей", "Борис", "Виктор", "Глеб", "Денис", "Иван", "Кирилл", "Максим", "Никита", "Олег")
FEMALE_CYRILLIC = ("Алина", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Марина", "Нина", "Ольга", "Софья")
#: More first names that make a name of two words one without a form of address.
MEN = ("Alexander", "Andrew", "Anthony", "Brian", "Charles", "Christopher", "Edward", "Eric", "George", "Hans", "Heinrich", "Henry", "Jack", "Jacob", "James", "Jason", "Jean", "John", "Jose", "Joseph", "Juan", "Jürgen", "Karl", "Kevin", "Klaus", "Luis", "Mark", "Matthew", "Michael", "Miguel", "Nicholas", "Pedro", "Peter", "Philip", "Pierre", "Richard", "Robert", "Ryan", "Stefan", "Steven", "Thomas", "Timothy", "William", "Wolfgang")
WOMEN = ("Amanda", "Amy", "Angela", "Barbara", "Carmen", "Carol", "Catherine", "Charlotte", "Claudia", "Deborah", "Elizabeth", "Emily", "Grace", "Hannah", "Isabel", "Jane", "Jennifer", "Jessica", "Karen", "Katharina", "Linda", "Lisa", "Lucia", "Margaret", "Marie", "Mary", "Michelle", "Monika", "Nancy", "Olivia", "Patricia", "Petra", "Rachel", "Rebecca", "Sabine", "Sandra", "Sarah", "Sophie", "Susan", "Ursula")
SYLLABLES = ("bar", "bel", "cor", "dan", "del", "fer", "gal", "han", "jor", "kel", "lan", "mar", "nor", "pel", "ros", "san", "tor", "val", "wen", "zan")
SYLLABLES_CYRILLIC = ("бар", "бел", "вор", "дан", "дел", "гор", "жал", "кан", "кор", "лан", "мар", "нор", "пел", "рос", "сан", "тор")
LATIN, CYRILLIC, HEX = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя", "0123456789abcdef"

FORMS = "|".join(sorted((*MALE_FORMS, *FEMALE_FORMS, *OTHER_FORMS), key=len, reverse=True))
MALE_GIVEN, FEMALE_GIVEN = (*MALE, *MEN, *MALE_CYRILLIC), (*FEMALE, *WOMEN, *FEMALE_CYRILLIC)
GIVEN = "|".join(sorted((*MALE_GIVEN, *FEMALE_GIVEN), key=len, reverse=True))
# quantifiers over groups are possessive or bounded, so no match recurses with the length of the text
L = r"\p{L}\p{M}"
EMAIL = rf"(?<![{L}\p{{N}}._%+\-])[{L}\p{{N}}._%+\-]++@[{L}\p{{N}}\-]++(?:\.[{L}\p{{N}}\-]++)++"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
IP = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.]*\d)"
_H = "[0-9A-Fa-f]{1,4}"
IP6 = rf"(?<![\p{{L}}\p{{N}}:.])(?=[A-Fa-f:]{{0,20}}\d)(?:(?:{_H}:){{7}}{_H}|(?:{_H}:){{1,7}}:(?:{_H}(?::{_H}){{0,5}})?|::(?:{_H}:){{0,6}}{_H})(?![\p{{L}}\p{{N}}:])"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
PHONE = r"(?<![\d+])(?:\+\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]\d{3,4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .\-]?\d{2,4}){2,4}(?!\d)|(?<![\d.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\d\-])"
CARD = r"(?<![\d])\d(?:[ \-]?\d){12,18}(?![\d])"
WORD = rf"(?=\p{{Lu}}['’]?\p{{L}})\p{{Lu}}[\p{{Ll}}\p{{M}}]*+(?:['’\-]?\p{{Lu}}[\p{{Ll}}\p{{M}}]++)*+(?![{L}])"
NAME = rf"(?<![{L}])(?:(?:{FORMS})\.? {WORD}(?: {WORD})?|(?=\p{{Lu}})(?:{GIVEN}) {WORD})"
FORM = rf"^((?:{FORMS})\.?) "
ENTITY = "|".join((EMAIL, SSN, IP, IP6, IBAN, PHONE, CARD, NAME))
#: What a text must have to hold an entity; nearly all texts are done after this.
MAY = rf"[@\d]|(?<![{L}])(?:(?:{FORMS})\.? \p{{Lu}}|(?=\p{{Lu}})(?:{GIVEN}) \p{{Lu}})"
FREE, MOST = 20, 100


def kind_of(e: Column) -> Column:
    rules = (("email", "@"), ("ssn", rf"^{SSN}$"), ("ip", rf"^{IP}$"), ("ip6", r"^[0-9A-Fa-f]*:[0-9A-Fa-f:]+$"), ("iban", rf"^{IBAN}$"), ("phone", rf"^(?:{PHONE})$"), ("card", rf"^{CARD}$"))
    out = F.when(e.rlike(rules[0][1]), F.lit(rules[0][0]))
    for kind, rule in rules[1:]:
        out = out.when(e.rlike(rule), F.lit(kind))
    return out.when(bare(e).contains(" "), F.lit("name")).otherwise(F.lit("family"))


def bare(e: Column) -> Column:
    return F.regexp_replace(e, FORM, "")


def family(e: Column) -> Column:
    return F.substring_index(e, " ", -1)


def canonical(e: Column, kind: Column) -> Column:
    """One form for all mentions of an entity: addresses in lower case, digits alone, names without form of address."""
    return F.when(kind.isin("email", "ip", "ip6"), F.lower(e)).when(kind == "iban", F.replace(e, F.lit(" "), F.lit(""))).when(kind.isin("name", "family"), F.lower(bare(e))).otherwise(F.regexp_replace(e, r"[^\d]", ""))


def trait(e: Column, kind: Column) -> Column:
    """What the mention itself shows: a person's gender (0 male, 1 female), the digits of a number's country code; or null."""
    plain = F.regexp_replace(F.regexp_extract(e, FORM, 1), r"\.$", "")
    country = F.length(F.regexp_replace(F.regexp_extract(e, r"^(\+\d{1,3})[ .(\-]", 1), r"\D", ""))
    return F.when(kind == "name", F.when(plain.isin(*MALE_FORMS), 0).when(plain.isin(*FEMALE_FORMS), 1)).when((kind == "phone") & (country > 0), country)


def no_tries() -> Column:
    return F.create_map().cast("map<string,struct<attempt:int,common:int>>")


def hashed(key: str, entity: Column, attempt: Column) -> Column:
    return F.sha2(F.concat(F.lit(key), F.lit("|"), entity, F.lit("|"), attempt.cast("string")), 256)


def number(h: Column, at: int, below: int) -> Column:
    """A number below ``below`` from the nine hex digits of the hash at ``at``."""
    return F.conv(F.substring(h, at, 9), 16, 10).cast("long") % below


def stream(h: Column) -> Column:
    """36 decimal digits from the hash."""
    return F.concat(*[F.lpad(number(h, 1 + 9 * k, 10**6).cast("string"), 6, "0") for k in range(6)])


def laid_out(mention: Column, digits: Column, skip: Column) -> Column:
    """``mention`` with its digits after the first ``skip`` replaced by ``digits``, one after the other."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))

    def step(acc, c):
        is_digit = c.rlike(r"^\d$")
        new = F.when(is_digit & (acc["k"] >= skip), F.substring(digits, acc["k"] - skip + F.lit(1), F.lit(1))).otherwise(c)
        return F.struct(F.concat(acc["out"], new).alias("out"), (acc["k"] + is_digit.cast("int")).alias("k"))

    return F.aggregate(F.split(mention, ""), start, step)["out"]


def shaped(part: Column, h: Column) -> Column:
    """Letters for letters and digits for digits, case and separators kept; letters without case become Latin ones."""

    def one(c, i):
        n = F.conv(F.substring(h, (i * 7) % 61 + F.lit(1), F.lit(4)), 16, 10).cast("int") + i
        pick = lambda letters: F.substring(F.lit(letters), (n % len(letters) + 1).cast("int"), F.lit(1))
        letter = F.when(c.rlike(r"^\p{IsCyrillic}$"), pick(CYRILLIC)).otherwise(pick(LATIN))
        return F.when(c.rlike(r"^\p{Lu}$"), F.upper(letter)).when(c.rlike(r"^\p{L}$"), letter).when(c.rlike(r"^\p{N}$"), (n % 10).cast("string")).when(c.rlike(r"^\p{M}$"), F.lit("")).otherwise(c)

    return F.array_join(F.transform(F.split(part, ""), one), "")


def shaped_hex(part: Column, h: Column) -> Column:
    """Hexadecimal digits for hexadecimal digits, colons kept; groups don't begin with 0 but where they did."""

    def one(c, i):
        n = F.conv(F.substring(h, (i * 7) % 61 + F.lit(1), F.lit(4)), 16, 10).cast("int") + i
        digit = F.substring(F.lit(HEX), (n % 15 + 2).cast("int"), F.lit(1))
        return F.when(c.rlike("^[A-F]$"), F.upper(digit)).when(c.rlike("^[0-9a-f]$"), digit).otherwise(c)

    return F.array_join(F.transform(F.split(part, ""), one), "")


def spaced(mention: Column, plain: Column) -> Column:
    """``plain``, one sign after the other, with the spaces of ``mention``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def step(acc, c):
        gap = c == " "
        return F.struct(F.concat(acc["out"], F.when(gap, c).otherwise(F.substring(plain, acc["k"], F.lit(1)))).alias("out"), (acc["k"] + (~gap).cast("int")).alias("k"))

    return F.aggregate(F.split(mention, ""), start, step)["out"]


def mod97(text: Column) -> Column:
    """The remainder by 97 of an account number's digits, letters being 10 to 35."""
    code = lambda c: F.when(c.rlike(r"^\d$"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda acc, c: (acc * F.when(code(c) > 9, 100).otherwise(10) + code(c)) % 97)


def luhn(digits: Column) -> Column:
    """The sum whose multiples of ten mark valid card numbers."""
    odd = F.length(digits) % 2

    def add(acc, x):
        d = F.substring(digits, x, F.lit(1)).cast("int") * F.when(x % 2 != odd, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def picked(names: tuple[str, ...], h: Column, at: int) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in names]), (number(h, at, len(names)) + 1).cast("int"))


def staged(found: Column, tries: Column) -> Column:
    """For each mention: e, kind, entity, own (trait), attempt, common (trait), of (its family name's entity), again (its
    attempt); step by step, so that each part is computed once."""
    parts = lambda s, *names: [s[n].alias(n) for n in names]
    kinds = F.transform(found, lambda e: F.struct(e.alias("e"), kind_of(e).alias("kind")))
    named = F.transform(kinds, lambda s: F.struct(*parts(s, "e", "kind"), F.concat(s["kind"], F.lit(":"), canonical(s["e"], s["kind"])).alias("entity"), trait(s["e"], s["kind"]).alias("own"), F.when(s["kind"].isin("name", "family"), F.concat(F.lit("family:"), F.lower(family(s["e"])))).alias("of")))
    known = F.transform(named, lambda s: F.struct(*parts(s, "e", "kind", "entity", "own", "of"), F.element_at(tries, s["entity"]).alias("t"), F.element_at(tries, s["of"])["attempt"].alias("again")))
    return F.transform(known, lambda s: F.struct(*parts(s, "e", "kind", "entity", "own", "of"), F.coalesce(s["t"]["attempt"], F.lit(0)).alias("attempt"), s["t"]["common"].alias("common"), F.coalesce(s["again"], F.lit(0)).alias("again")))


def surrogates(found: Column, key: str, tries: Column) -> Column:
    """The replacements of the mentions ``found``; ``tries``: a map from entity to attempt (0 for those not in it) and common trait."""
    parts = lambda s, *names: [s[n].alias(n) for n in names]
    kept = ("e", "kind", "own", "common", "attempt", "again")
    hashes = F.transform(staged(found, tries), lambda s: F.struct(*parts(s, *kept), hashed(key, s["entity"], s["attempt"]).alias("h"), hashed(key, s["of"], s["again"]).alias("hf")))
    digits = F.transform(hashes, lambda s: F.struct(*parts(s, *kept, "h", "hf"), stream(s["h"]).alias("stream"), F.regexp_replace(s["e"], r"[^\d]", "").alias("digits"), bare(s["e"]).alias("bare")))
    return F.transform(digits, lambda s: replacement(s["e"], s["kind"], s["h"], s["stream"], s["digits"], s["bare"], s["own"], s["common"], s["attempt"], s["hf"], s["again"]))


def syllables(h: Column, attempt: Column, cyrillic: Column) -> Column:
    """Four syllables; six from the first further attempt on, twelve from the second."""
    made = []
    for names in (SYLLABLES, SYLLABLES_CYRILLIC):
        some = lambda of, n, names=names, first=1: F.concat(*[picked(names, of, first + 9 * k) for k in range(n)])
        made.append(F.initcap(F.concat(some(h, 4, first=10), F.when(attempt > 0, some(h, 2, first=46)).otherwise(""), F.when(attempt > 1, some(F.sha2(h, 256), 6)).otherwise(""))))
    return F.when(cyrillic, made[1]).otherwise(made[0])


def replacement(e: Column, kind: Column, h: Column, digits: Column, own: Column, bare: Column, shown: Column, common: Column, attempt: Column, hf: Column, again: Column) -> Column:
    """The surrogate of the mention ``e``; own: its digits, bare: a name without its form of address, digits: the hash's.

    shown: the mention's trait, common: its entity's, given where mentions differ; hf, again: its family name's hash and attempt.
    """
    # telephone: the country code stays, the first digit after it is 2 to 9
    phone = laid_out(e, F.concat((number(h, 55, 8) + 2).cast("string"), digits), F.coalesce(common, shown, F.lit(0)))
    # card: the first digit stays; the last makes the number valid if it was
    some = F.concat(F.left(own, F.lit(1)), F.substring(digits, F.lit(1), F.length(own) - 2))
    check = (10 - luhn(F.concat(some, F.lit("0"))) % 10) % 10
    last = F.when(luhn(own) % 10 == 0, check).otherwise(number(h, 55, 10).cast("int")).cast("string")
    card = laid_out(e, F.concat(F.substring(some, F.lit(2), F.length(own)), last), F.lit(1))
    # account: the country stays; the check digits make the number valid if it was
    country, had = F.left(e, F.lit(2)), F.replace(F.substring(e, F.lit(5), F.length(e)), F.lit(" "), F.lit(""))
    rest, valid = shaped(had, h), mod97(F.concat(had, F.left(e, F.lit(4)))) == 1
    right = F.lpad((98 - mod97(F.concat(rest, country, F.lit("00")))).cast("string"), 2, "0")
    iban = spaced(e, F.concat(country, F.when(valid, right).otherwise(F.left(digits, F.lit(2))), rest))
    ip = F.concat_ws(".", *[(number(h, 1 + 9 * k, 223 if k == 0 else 254) + 1).cast("string") for k in range(4)])
    local, domain = F.substring_index(e, "@", 1), F.substring_index(e, "@", -1)
    more = F.left(F.translate(F.sha2(h, 256), "0123456789", "ghijklmnop"), 4 * attempt)
    email = F.concat(shaped(local, h), more, F.lit("@"), shaped(F.lower(F.substring_index(domain, ".", 1)), F.reverse(h)), F.lit(".example.net"))
    form, given = F.regexp_extract(e, FORM, 1), F.substring_index(bare, " ", 1)
    usual = F.when(given.isin(*MALE_GIVEN), 0).when(given.isin(*FEMALE_GIVEN), 1)
    gender = F.coalesce(shown, common, usual, number(h, 46, 2).cast("int"))
    cyrillic = bare.rlike(r"\p{IsCyrillic}")
    names = F.array(*[F.array(*[F.lit(x) for x in n]) for n in (MALE, FEMALE, MALE_CYRILLIC, FEMALE_CYRILLIC)])
    of = F.element_at(names, gender + F.when(cyrillic, 3).otherwise(1))
    first = F.element_at(of, (F.conv(F.substring(h, 1, 9), 16, 10).cast("long") % F.size(of) + 1).cast("int"))
    first = F.concat(first, F.when(attempt > 0, F.concat(F.lit("-"), syllables(h, attempt - 1, cyrillic))).otherwise(""))
    surname = F.concat(syllables(hf, again, cyrillic), F.when(~cyrillic, "").when(F.lower(bare).rlike("[ая]$"), "ова").otherwise("ов"))
    name = F.concat(form, F.when(form == "", "").otherwise(" "), F.when(kind == "name", F.concat(first, F.lit(" "))).otherwise(""), surname)
    ssn = laid_out(e, F.concat((number(h, 55, 8) + 1).cast("string"), digits), F.lit(0))
    return F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "card", card).when(kind == "iban", iban).when(kind == "ip", ip).when(kind == "ip6", shaped_hex(e, h)).when(kind == "ssn", ssn).otherwise(name)


def families(found: Column) -> Column:
    """The distinct family names of the names among the mentions ``found``."""
    names = F.filter(found, lambda e: ~e.rlike(r"[@\d:]"))
    return F.array_distinct(F.transform(names, family))


def searched(docs: DataFrame, text: str, pattern: str, found: str) -> DataFrame:
    """``docs`` with found, the mentions in ``text`` (an empty list if none or null), and pattern, null where ENTITY finds them all.

    A text that names people has a pattern of its own, which finds their family names also where they stand alone.
    """
    first, none = F.regexp_extract_all(F.col(text), F.lit(ENTITY), 0), F.array().cast("array<string>")
    df = docs.withColumn(found, F.coalesce(F.when(F.col(text).rlike(MAY), first), none))
    df = df.withColumn(pattern, families(F.col(found)))
    df = df.withColumn(pattern, F.when(F.size(pattern) > 0, F.concat(F.lit(ENTITY + rf"|(?<![{L}])(?:"), F.array_join(pattern, "|"), F.lit(rf")(?![{L}])"))))
    return df.withColumn(found, F.when(F.col(pattern).isNull(), F.col(found)).otherwise(F.regexp_extract_all(F.col(text), F.col(pattern), F.lit(0))))


def entities(docs: DataFrame) -> DataFrame:
    """entity (kind:canonical form), own (trait), one mention with it, common (the entity's trait), several (traits) of ``docs`` (text)."""
    found = searched(docs.select(F.col("text").cast("string").alias("text")), "text", "pattern", "found").filter("size(found) > 0")
    every = F.array_union("found", families(F.col("found")))
    found = found.select(F.explode(staged(every, no_tries())).alias("m")).select("m.entity", "m.own", F.col("m.e").alias("mention"))
    of = Window.partitionBy("entity")
    return found.groupBy("entity", "own").agg(F.min("mention").alias("mention")).withColumns({"common": F.min("own").over(of), "several": F.count("*").over(of) > 1})


def attempts(known: DataFrame, key: str) -> DataFrame:
    """entity, attempt, common of the entities of ``known`` whose surrogates do not follow from each mention alone.

    That is, another attempt than the first is needed, or mentions differ in their trait. Rounds go on while a surrogate
    is shared or is itself an entity; the smallest entity keeps a shared one. People are compared with those of their own
    family name by their first names: no family name's surrogate is a family name of the corpus, or another's.
    """
    now, before = known.select("entity", "mention", "common", "several", F.lit(0).alias("attempt")), None
    for turn in range(MOST):
        tries = F.create_map("entity", F.struct("attempt", "common"))
        new = now.withColumn("new", surrogates(F.array("mention"), key, tries)[0])
        person = F.concat(F.lit("name:"), F.lower(F.substring_index(bare(F.col("new")), " ", 1)), F.lit("|"), family(F.col("entity")))
        made = F.when(F.col("entity").startswith("name:"), person).otherwise(staged(F.array("new"), tries)[0]["entity"])
        made = cut(new.select("entity", "mention", "common", "several", "attempt", made.alias("made")), "surrogates")
        forget(before)
        before = made
        shared = made.groupBy("made").agg(F.min("entity").alias("keeps"), F.max("entity").alias("last")).filter("keeps < last").drop("last")
        bad = made.join(shared, "made", "left")
        if turn < FREE:
            real = known.select(F.col("entity").alias("made"), F.lit(True).alias("real")).distinct()
            bad = bad.join(real, "made", "left").filter((F.col("entity") != F.col("keeps")) | F.col("real"))
        else:
            bad = bad.filter(F.col("entity") != F.col("keeps"))
        again = cut(bad.select("entity").distinct(), "collisions")
        if not again.limit(1).count():
            return made.filter("attempt > 0 or several").select("entity", "attempt", "common").distinct()
        now = made.join(again.withColumn("again", F.lit(1)), "entity", "left").select("entity", "mention", "common", "several", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt"))
    raise ValueError("entities of one type are more than its surrogates")


def rewritten(text: Column, pattern: Column, found: Column, key: str, tries: Column) -> Column:
    """``text`` with its mentions ``found`` replaced; ``tries``: a map from entity to attempt and common trait, of those that need it."""
    gaps = F.when(pattern.isNull(), F.split(text, ENTITY)).otherwise(F.split(text, pattern))
    return F.array_join(F.zip_with(gaps, surrogates(found, key, tries), lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")


def surrogated(docs: DataFrame, key: str, replaced: str | None = "n_replaced") -> DataFrame:
    """``docs`` with every detected entity in ``text`` replaced by surrogates of the secret ``key``.

    ``replaced`` (unless None) is a last column that counts them; where ``docs`` has a column of that name, signs are added
    to the new one's. A null text stays null, an empty one empty, with 0 replaced. Texts of any length are whole. Rows are
    rewritten by text alone: repeated rows agree, ties don't arise, other columns pass, whatever their names. An empty
    table gives no rows.
    """
    known = cut(entities(docs), "entities")
    other = attempts(known, key)
    text, pattern, found, tries, mark = unused(docs, 5)
    count = next(c for c in (replaced + "_" * i for i in range(len(docs.columns) + 1)) if c.lower() not in {x.lower() for x in docs.columns}) if replaced else None
    df = searched(docs.withColumn(text, F.col("text").cast("string")), text, pattern, found)
    if not other.limit(1).count():
        df = df.withColumn(tries, no_tries())
    else:
        # the few texts that hold such an entity get their own map, by the text's hash
        own = df.filter(F.size(found) > 0).select(F.sha2(text, 256).alias(mark), F.explode(staged(F.col(found), no_tries())).alias("m")).select(mark, F.explode(F.array_compact(F.array("m.entity", "m.of"))).alias("entity")).distinct()
        maps = cut(own.join(other, "entity").groupBy(mark).agg(F.map_from_entries(F.collect_list(F.struct("entity", F.struct("attempt", "common")))).alias(tries)), "attempt-maps")
        if maps.count() <= 10_000:
            maps = F.broadcast(maps)
        df = df.withColumn(mark, F.sha2(text, 256)).join(maps, mark, "left").withColumn(tries, F.coalesce(tries, no_tries()))
    new = F.when(F.size(found) > 0, rewritten(F.col(text), F.col(pattern), F.col(found), key, F.col(tries))).otherwise(F.col(text))
    return df.select(*[new.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns], *([F.size(found).alias(count)] if count else []))
