import re

from pyspark.sql import functions as F

from sparkwright.llm import surrogates as s

from .helpers import documents, empty, frame

KEY = "test"
TEXT = "Write to Ann.Lee7@mail.example.com or ann.lee7@MAIL.example.com, call +1 (415) 555-2671, card 4539 1488 0343 6467, ip 10.20.30.40, ssn 123-45-6789. Mrs. Maria Gomez met Mr. Gomez; г-н Иван Петров."


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if 2 * x > 9 else 2 * x) for i, x in enumerate(map(int, d[::-1]))) % 10 == 0


def test_types_formats_and_coreference(spark):
    rows = [(1, TEXT, "en", "s"), (2, "again 4539148803436467 and +1 415 555 2671, ANN.LEE7@mail.example.com.", "en", "s"), (3, None, None, None), (4, "", "en", "s")]
    got = {r["doc_id"]: r for r in s.surrogated(frame(spark, rows), KEY).collect()}
    out = got[1]["text"]
    assert got[1]["n_replaced"] == 9 and got[3]["text"] is None and got[3]["n_replaced"] == 0 and got[4]["text"] == ""
    for x in ("Lee7", "555-2671", "1488", "10.20.30.40", "123-45", "Gomez", "Иван", "Петров"):
        assert x not in out
    m = re.fullmatch(r"Write to ([A-Za-z]{3}\.[A-Za-z]{3}\d)@(\w+)\.example\.net or ([a-z.\d]+)@(\w+)\.example\.net, call (\+1 \(\d{3}\) \d{3}-\d{4}), card (\d{4} \d{4} \d{4} \d{4}), ip (\d+\.\d+\.\d+\.\d+), ssn (\d{3}-\d{2}-\d{4})\. Mrs\. ([A-Z][a-z]+) ([A-Z][a-z]+) met Mr\. ([A-Z][a-z]+); г-н ([А-Я][а-я]+) ([А-Я][а-я]+)\.", out)
    assert m, out
    assert m[1].lower() == m[3] and m[1][0].isupper() and luhn(m[6].replace(" ", "")) and m[6][0] == "4"
    assert m[9] in s.FEMALE and m[12] in s.MALE_CYRILLIC
    assert m[6].replace(" ", "") in got[2]["text"] and re.sub(r"\D", "", m[5])[1:] in re.sub(r"\D", "", got[2]["text"]) and f"{m[2]}.example.net" in got[2]["text"]
    other = s.surrogated(frame(spark, rows), key="another").filter("doc_id = 1").first()["text"]
    assert other != out


def test_collisions_are_resolved(spark, monkeypatch):
    few = lambda e, kind, h, *_: F.concat(F.lit("+1 (9"), F.lpad(s.number(h, 1, 90).cast("string"), 2, "0"), F.lit(") 555-0000"))
    monkeypatch.setattr(s, "replacement", few)
    people = [f"+1 (200) 555-{i:04d}" for i in range(40)] + ["+1 (905) 555-0000"]
    rows = [(i, f"call {p} or {people[0]} now", "en", "s") for i, p in enumerate(people)]
    made = {r["doc_id"]: re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}", r["text"]) for r in s.surrogated(frame(spark, rows), KEY).collect()}
    assert len({m[0] for m in made.values()}) == 41 and len({m[1] for m in made.values()}) == 1
    assert "+1 (905) 555-0000" not in {x for m in made.values() for x in m}


def test_one_surrogate_whatever_the_form_shows(spark):
    people = [f"{f} {'Smith' if f < 'J' else 'Young'}" for f in ("Adam", "Bert", "Carl", "Dora", "Emil", "Frank", "Greg", "Hans", "Jack", "Karl", "Lars", "Mike")]
    rows = [(2 * i + k, f"{form} {p} came.", "en", "s") for i, p in enumerate(people) for k, form in enumerate(("Mr.", "Dr."))]
    rows += [(100, "г-жа Анна Ким.", "ru", "s"), (101, "Dr. Анна Ким. Prof. Анна Ким.", "ru", "s"), (102, "call +15551234567 now", "en", "s"), (103, "call +1 555 123 4567 now", "en", "s"), (104, "Ms. Adam Smith came.", "en", "s")]
    got = {r["doc_id"]: r["text"] for r in s.surrogated(frame(spark, rows), KEY).collect()}
    bare = {i: re.sub(r"^\S+ ", "", t) for i, t in got.items()}
    for i in range(len(people)):
        assert bare[2 * i] == bare[2 * i + 1] and bare[2 * i].split()[0].split("-")[0] in s.MALE
    assert len({bare[2 * i] for i in range(len(people))}) == len(people)
    assert bare[101] == f"{bare[100]} Prof. {bare[100]}" and bare[100].split()[0] in s.FEMALE_CYRILLIC
    assert re.sub(r"\D", "", got[102]) == re.sub(r"\D", "", got[103]) and got[103].startswith("call +1 ") and "5551234567" not in got[102]
    assert bare[104].split()[0].split("-")[0] in s.FEMALE


def test_people_of_one_family_name_stay_distinct(spark):
    people = [f"{a}{b}" for a in "BCDFG" for b in ("an", "en", "in", "on", "un", "ar", "er", "or")]
    rows = [(i, f"Mr. {p} Smith and Ms. {p} Smith came, then Dr. Smith", "en", "s") for i, p in enumerate(people)]
    men, women, families = set(), set(), set()
    for r in s.surrogated(frame(spark, rows), KEY).collect():
        m = re.fullmatch(r"Mr\. (\S+) (\S+) and Ms\. (\S+) (\S+) came, then Dr\. (\S+)", r["text"])
        men.add(m[1])
        women.add(m[3])
        families |= {m[2], m[4], m[5]}
    assert len(men) == len(women) == len(people) and len(families) == 1 and not men & women


def test_family_names_stand_alone_and_usual_first_names(spark):
    rows = [(1, "Dr. John O'Brien spoke. O'Brien and Mr. O'Brien left; Maria García-López stayed. McDonald came.", "en", "s"), (2, "Mr. O'Brien. John O'Brien. MR. JOHN. Mr. J", "en", "s"), (3, "O'Brien alone", "en", "s")]
    got = {r["doc_id"]: r["text"] for r in s.surrogated(frame(spark, rows), KEY).collect()}
    m = re.fullmatch(r"Dr\. (\S+) (\w+) spoke\. (\w+) and Mr\. (\w+) left; (\S+) (\w+) stayed\. McDonald came\.", got[1])
    assert m and m[2] == m[3] == m[4] != m[6] and m[1] in s.MALE and m[5] in s.FEMALE
    assert got[2] == f"Mr. {m[2]}. {m[1]} {m[2]}. MR. JOHN. Mr. J" and got[3] == rows[2][1]


def test_addresses_and_accounts(spark):
    iban = "DE89 3704 0044 0532 0130 00"
    text = f"hans.müller@firma.de иван@почта.рф a@b.cc 2001:db8::8a2e:370:7334 fe80:0:0:0:1:2:3:4 {iban} std::vector a::b 12:30:45 {iban.replace(' ', '')}"
    out = s.surrogated(frame(spark, [(1, text, "de", "s")]), KEY).first()
    w = out["text"].split()
    assert out["n_replaced"] == 7
    for x in ("ller", "firma", "иван", "почта", "8a2e", "fe80", "3704"):
        assert x not in out["text"]
    assert re.fullmatch(r"[a-z]{4}\.[a-z]{6}@[a-z]{5}\.example\.net", w[0]) and re.fullmatch(r"[а-я]{4}@[а-я]{5}\.example\.net", w[1])
    assert re.fullmatch(r"[0-9a-f]{4}:[0-9a-f]{3}::[0-9a-f]{4}:[0-9a-f]{3}:[0-9a-f]{4}", w[3]) and "std::vector a::b 12:30:45" in out["text"]
    made = "".join(w[5:11])
    assert made == w[-1] and made[:2] == "DE" and len(made) == 22 and int("".join(str(int(c, 36)) for c in made[4:] + made[:4])) % 97 == 1


def test_very_long_addresses_and_texts(spark):
    rows = [(1, "x a@b" + ".c" * 500_000, "en", "s"), (2, "y" * 1_000_000 + " " + "a1." * 300_000 + " " + "1.2." * 100_000 + ":1" * 100_000, "en", "s"), (3, "Mr. " + "Ab-" * 100_000 + "A", "en", "s")]
    got = {r["doc_id"]: r for r in s.surrogated(frame(spark, rows), KEY).collect()}
    assert re.fullmatch(r"x [a-z]@[a-z]\.example\.net", got[1]["text"]) and len(got[2]["text"]) == len(rows[1][1])


def test_many_short_names_end_and_stay_distinct(spark):
    n = 30_000  # of 160,000 names of the first attempt, so many collide
    letters = "abcdefghijklmnop"
    name = lambda i: "Q" + "".join(letters[(i >> 4 * k) & 15] for k in range(5))
    df = spark.range(n).selectExpr("id as doc_id", "concat('Mr. Q', translate(lpad(lower(hex(id)), 5, '0'), '0123456789abcdef', 'abcdefghijklmnop'), ' came') as text")
    out = s.surrogated(df, KEY).select("text")
    assert out.distinct().count() == n and len(name(3)) == 6
    assert out.filter("text rlike '^Mr. Q[a-p]{5} came$'").count() == 0


def test_distinct_entities_stay_distinct_and_one_stays_one(spark):
    """All pairs of mentions: equal canonical forms have equal surrogates, others different ones."""
    import random

    rng = random.Random(1)
    mails = [f"{c}@{d}.org" for c in "abcdefgh" for d in ("x", "y", "z")]
    phones = [f"({rng.randrange(200, 999)}) 555-{rng.randrange(10**4):04d}" for _ in range(40)]
    cards = ["".join(rng.choice("0123456789") for _ in range(15)) for _ in range(40)]
    every = [*mails, *phones, *cards]
    spelled = lambda e: rng.choice([e, e.upper()]) if "@" in e else (f"{e[:4]} {e[4:10]} {e[10:]}" if rng.random() < 0.5 and e.isdigit() else e)
    texts = [[spelled(e) for e in rng.choices(every, k=6)] for _ in range(80)]
    rows = [(i, " ; ".join(t), "en", "s") for i, t in enumerate(texts)]
    form = lambda e: re.sub(r"\D", "", e) if "@" not in e else e.lower()
    pairs = {(form(a), form(b)) for r in s.surrogated(frame(spark, rows), KEY).collect() for a, b in zip(texts[r["doc_id"]], r["text"].split(" ; "), strict=True)}
    assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)
    assert not {a for a, _ in pairs} & {b for _, b in pairs}


def test_columns_of_any_name_pass(spark):
    df = spark.createDataFrame([(1, "to a@b.org", 5, "x", "y", None), (1, None, 6, None, "y", 2)], "doc_id long, text string, n_replaced int, __x string, own_0 string, `a.b` int")
    out = s.surrogated(df, KEY)
    assert out.columns == [*df.columns, "n_replaced_"]
    assert sorted((r["n_replaced"], r["n_replaced_"], r["__x"], r["own_0"], r["a.b"]) for r in out.collect()) == [(5, 1, "x", "y", None), (6, 0, None, "y", 2)]


def test_clean_texts_and_columns_stay(spark):
    rows = documents()
    df = frame(spark, rows)
    out = s.surrogated(df, KEY, replaced=None)
    assert out.columns == df.columns
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, (tuple(r) for r in df.collect())))
    assert s.surrogated(empty(spark), KEY).count() == 0
