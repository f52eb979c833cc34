"""Secret scans: a random forest removes false positives, in DataFrame and MLlib operations only.

Candidates are what broad rules find: long runs of key characters with a digit, known key prefixes, and what is
assigned to a name such as password or token. Each is described by its length, its transitions between kinds of
characters and how usual its letter pairs are, the share of it that words of the dictionary cover, its variety, the path
(source) it comes from, and the words around it. A random forest trained from labelled findings gives the probability
of a secret; candidates below ``least`` are dropped.

Dictionary and letter pairs are counted from the corpus: words of at least ``SHARE`` of all its words (so at most
1 / SHARE) and those of a short list, and the pairs in all its words by their number.

``findings``: candidate, before, after, path, label (0 or 1). The default is a set made here by rules, of ``FINDINGS``
rows; a reviewed set takes its place by the same columns. Fitting uses at most ``FIT`` rows, taken by hash.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.llm.common import cut

FINDINGS, FIT, SHARE = 6000, 50_000, 1e-4
BEFORE, AFTER = 48, 24
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Names that secrets are assigned to, key prefixes, words of doubt, the dictionary, usual letter pairs.
NAMES = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "auth", "credential", "private_key", "bearer")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "xoxb-", "xoxp-", "sk_live_", "AIza", "glpat-")
DOUBT = ("example", "sample", "dummy", "test", "fake", "placeholder", "changeme", "your", "xxxx", "todo", "mock")
OTHERS = ("commit", "revision", "sha1", "sha256", "md5", "checksum", "digest", "uuid", "id", "request", "image", "base64", "file", "version", "etag")
DICTIONARY = ("about", "access", "account", "admin", "after", "all", "and", "api", "app", "auth", "base", "build", "case", "change", "class", "client", "code", "config", "count", "data", "date", "default", "delete", "dev", "dir", "error", "event", "example", "false", "field", "file", "first", "for", "from", "get", "group", "handler", "have", "here", "host", "index", "info", "input", "item", "key", "last", "level", "line", "list", "local", "log", "main", "manager", "map", "max", "message", "min", "model", "name", "new", "node", "not", "null", "number", "object", "open", "option", "order", "output", "page", "param", "pass", "password", "path", "point", "port", "private", "public", "query", "read", "record", "release", "request", "result", "root", "row", "sample", "secret", "server", "service", "session", "set", "size", "source", "start", "state", "string", "table", "task", "test", "text", "the", "time", "token", "total", "true", "type", "update", "user", "value", "version", "view", "with", "word", "work", "write", "your")
PAIRS = ("th", "he", "in", "er", "an", "re", "on", "at", "en", "nd", "ti", "es", "or", "te", "of", "ed", "is", "it", "al", "ar", "st", "to", "nt", "ng", "se", "ha", "as", "ou", "io", "le", "ve", "co", "me", "de", "hi", "ri", "ro", "ic", "ne", "ea", "ra", "ce")

# the short looks back spare most places the long one, which implies them
ASSIGNED = rf"(?<=[:=\s\"'])(?<=[:=][\s\"']{{0,3}})(?<=(?:{'|'.join(NAMES)})[\"']?\s{{0,2}}[:=]\s{{0,2}}[\"']?)[^\s\"',;:=]{{6,}}+"
RUN = r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*+\d)[A-Za-z0-9+/_\-]{16,}+={0,2}"
PREFIXED = rf"(?:{'|'.join(PREFIXES)})[A-Za-z0-9+/_\-]{{12,}}+={{0,2}}"
CANDIDATE = rf"(?i:{ASSIGNED})|{RUN}|{PREFIXED}"
#: What a text must have to hold a candidate: the digit of a run, a name, or a prefix.
MAY = rf"\d|(?i:{'|'.join(NAMES)})|{'|'.join(PREFIXES)}"
FEATURES = ("length", "transitions", "pairs", "covered", "variety", "digits", "uppers", "hex", "prefix", "repeats", "named", "assigned", "quoted", "doubted", "other", "test_path", "words_around")


def either(words: tuple[str, ...]) -> str:
    return "|".join(words)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, path, at (number within the text), candidate, before, after of each candidate in ``docs`` (doc_id, text, source)."""
    text = F.col("text")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")).alias("path"), F.col("text").cast("string").alias("text"))
    may = own.filter(text.rlike(MAY))
    both = may.select("doc_id", "path", F.split(text, CANDIDATE).alias("gaps"), F.regexp_extract_all(text, F.lit(CANDIDATE), 0).alias("found"))
    part = lambda column, at: F.coalesce(F.get(column, at), F.lit(""))
    # neighbours count as words around, so up to two of them and their gaps are part of what stands before and after
    before = lambda i: F.right(F.concat(*[x for k in (2, 1) for x in (F.right(part("gaps", i - k), F.lit(BEFORE)), F.right(part("found", i - k), F.lit(BEFORE)))], part("gaps", i)), F.lit(BEFORE))
    after = lambda i: F.left(F.concat(part("gaps", i + 1), *[x for k in (1, 2) for x in (F.left(part("found", i + k), F.lit(AFTER)), F.left(part("gaps", i + k + 1), F.lit(AFTER)))]), F.lit(AFTER))
    around = F.transform("found", lambda c, i: F.struct(c.alias("candidate"), before(i).alias("before"), after(i).alias("after")))
    # outer, then filtered: a filter on the lists would be pushed below them, and search each text twice
    return both.select("doc_id", "path", F.posexplode_outer(around).alias("at", "c")).filter("at is not null").select("doc_id", "path", "at", "c.*")


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def vocabulary(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """word, n, usual (boolean: at least ``share`` of all words) of the corpus's words of 2 to 16 letters, all of DICTIONARY being usual."""
    words = docs.select(F.explode(F.split(F.lower(F.col("text").cast("string")), "[^a-z]+")).alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter("length(word) between 2 and 16")
    base = docs.sparkSession.range(1).select(F.explode(F.array(*[F.lit(w) for w in DICTIONARY])).alias("word"), F.lit(1).cast("long").alias("n"), F.lit(True).alias("base"))
    every = words.withColumn("base", F.lit(False)).union(base).groupBy("word").agg(F.sum("n").alias("n"), F.max("base").alias("base"))
    total = every.agg(F.sum("n").alias("all"))
    return every.crossJoin(F.broadcast(total)).select("word", "n", (F.col("base") | (F.col("n") >= share * F.col("all"))).alias("usual"))


def pair_weights(words: DataFrame) -> list[float]:
    """The logarithm of each second letter's share after each first one (26 x 26, row by row) in the words by their number, one being added to each count."""
    pairs = words.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("pair"))
    counts = {r["pair"]: r["c"] for r in pairs.groupBy("pair").agg(F.sum("n").alias("c")).collect()}  # at most 676
    first = {a: sum(counts.get(a + b, 0) for b in LETTERS) for a in LETTERS}
    return [math.log((counts.get(a + b, 0) + 1) / (first[a] + 26)) for a in LETTERS for b in LETTERS]


def covered(rows: DataFrame, words: DataFrame) -> DataFrame:
    """key (hash of a candidate), covered: how many of its characters stand in usual words of 3 letters or more, cut at capitals and signs."""
    parts = rows.select(F.sha2("candidate", 256).alias("key"), "candidate").dropDuplicates(["key"])
    each = parts.select("key", F.explode(F.regexp_extract_all("candidate", F.lit("[A-Z]?[a-z]{2,}|[A-Z]{3,}"), 0)).alias("part")).withColumn("word", F.lower("part"))
    return each.join(words.filter("usual and length(word) > 2").select("word"), "word").groupBy("key").agg(F.sum(F.length("part")).alias("covered"))


def described(rows: DataFrame, words: DataFrame, weights: list[float]) -> DataFrame:
    """``rows`` (candidate, before, after, path) with the FEATURES; nulls count as empty."""
    rows = rows.withColumn("candidate", F.coalesce("candidate", F.lit("")))
    own = rows.withColumn("key", F.sha2("candidate", 256)).join(covered(rows, words), "key", "left").drop("key")
    c, before, after, path = (F.coalesce(F.col(x), F.lit("")) for x in ("candidate", "before", "after", "path"))
    n, low = F.length(c), F.lower(c)
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[a-z]", "l"), r"[A-Z]", "u"), r"\d", "d")
    near = F.lower(F.concat(before, F.lit(" "), after))
    table = F.array(*[F.lit(w) for w in weights])
    letters = F.split(F.regexp_replace(low, r"[^a-z]", ""), "")
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))

    def step(acc, x):  # one pass, the letter before being part of the state
        code = F.ascii(x) - 97
        weight = F.when((acc["last"] >= 0) & (code >= 0), F.get(table, acc["last"] * 26 + code)).otherwise(0.0)
        return F.struct(code.alias("last"), (acc["sum"] + weight).alias("sum"))

    values = {
        "length": n,
        "transitions": share(F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1, n),
        "pairs": share(F.aggregate(letters, start, step)["sum"], n),
        "covered": share(F.coalesce("covered", F.lit(0)), n),
        "variety": share(F.size(F.array_distinct(F.split(c, ""))), n),
        "digits": share(n - F.length(F.regexp_replace(c, r"\d", "")), n),
        "uppers": share(n - F.length(F.regexp_replace(c, r"[A-Z]", "")), n),
        "hex": c.rlike(r"^[0-9a-f]+$|^[0-9A-F]+$"),
        "prefix": c.rlike(rf"^(?:{either(PREFIXES)})"),
        "repeats": c.rlike(r"(.)\1{3}|(..)\2{2}|0123|1234|abcd"),
        "named": F.lower(before).rlike(rf"(?:{either(NAMES)})[^a-z]{{0,8}}$"),
        "assigned": before.rlike(r"[:=]\s{0,2}[\"']?$"),
        "quoted": before.rlike(r"[\"']$") & after.rlike(r"^[\"']"),
        "doubted": F.concat(near, F.lit(" "), low).rlike(either(DOUBT)),
        "other": F.lower(before).rlike(rf"\b(?:{either(OTHERS)})[^a-z]{{0,8}}$"),
        "test_path": F.lower(path).rlike(r"test|spec|fixture|example|sample|mock|docs?/"),
        "words_around": share(F.size(F.split(F.trim(near), r"\s+")), F.lit(12)),
    }
    return own.withColumns({f"f_{k}": v.cast("double") for k, v in values.items()})


def made_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """Labelled findings by rules: keys and passwords in their usual places; hashes, numbers, placeholders and names elsewhere."""
    h = F.sha2(F.concat(F.lit("finding:"), F.col("id").cast("string")), 512)
    pick = lambda words, at: F.element_at(F.array(*[F.lit(w) for w in words]), (F.conv(F.substring(h, at, 7), 16, 10).cast("long") % len(words) + 1).cast("int"))
    mixed = F.regexp_replace(F.base64(F.unhex(F.substring(h, 1, 64))), "[+/=]", "x")
    upper, digits = F.upper(F.substring(mixed, 1, 16)), F.substring(F.regexp_replace(h, "[a-f]", ""), 1, 16)
    size = (F.conv(F.substring(h, 100, 5), 16, 10).cast("int") % 30 + 12).cast("int")
    plain = lambda at: F.concat_ws(" ", pick(DICTIONARY, at), pick(PAIRS, at + 7), pick(DICTIONARY, at + 14))
    assign = F.concat(pick(NAMES, 70), pick((" = \"", "=", ": ", ": \"", " = '", "="), 80))
    joined = F.concat_ws("_", pick(DICTIONARY, 20), pick(DICTIONARY, 27), pick(DICTIONARY, 34), (F.conv(F.substring(h, 41, 3), 16, 10).cast("int") % 100).cast("string"))
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    kinds = [  # label, candidate, what stands right before it
        (1, F.substring(h, F.lit(1), size), assign), (1, F.substring(h, 1, 40), assign), (1, F.substring(mixed, F.lit(1), size), assign),
        (1, F.concat(pick(("AKIA", "ASIA"), 60), upper), F.lit(" ")), (1, F.concat(pick(PREFIXES[2:], 60), F.substring(mixed, 1, 36)), pick((" ", "=", ": \""), 66)),
        (1, F.concat(pick(DICTIONARY, 50), F.substring(mixed, 1, 12)), assign), (1, F.substring(mixed, F.lit(1), size), F.concat(pick(NAMES, 70), F.lit(" "))),
        (0, F.substring(h, 1, 40), F.concat(pick(OTHERS, 70), pick((" ", ": ", "="), 77))), (0, digits, F.lit(" ")), (0, uuid, F.concat(pick(OTHERS, 70), pick((" ", ": ", "="), 77))),
        (0, joined, assign), (0, joined, F.lit(" ")), (0, F.concat(pick(DOUBT, 50), pick(("1234", "_here", "-me-now", "xxxx1"), 57), pick(DICTIONARY, 63)), assign), (0, F.substring(h, F.lit(1), size), F.lit(" ")),
        (0, digits, F.concat(pick(OTHERS, 70), F.lit(" "))), (0, F.concat_ws("-", F.lit("2024"), pick(("01", "07", "11"), 50), pick(DICTIONARY, 53), pick(DICTIONARY, 60)), F.lit(" ")),
    ]
    n_kinds = len(kinds)
    alone = F.conv(F.substring(h, 125, 1), 16, 10).cast("int") < 4  # a quarter stand without other words
    at = lambda i: F.coalesce(*[F.when(F.col("id") % n_kinds == k, x[i] if i else F.lit(x[0])) for k, x in enumerate(kinds)])
    rows = spark.range(n).select(at(1).alias("candidate"), F.concat(F.when(alone, F.lit("")).otherwise(F.concat(plain(86), F.lit(" "))), at(2)).alias("before"), F.when(at(2).rlike("\"$"), F.lit("\" ")).when(at(2).rlike("'$"), F.lit("' ")).otherwise(F.lit(" ")).alias("tail"), F.when(alone, F.lit("")).otherwise(plain(1)).alias("next"), pick(("src0", "app/main", "lib/core", "conf/prod"), 110).alias("path"), at(0).alias("label"))
    return rows.select("candidate", F.right("before", F.lit(BEFORE)).alias("before"), F.left(F.concat("tail", "next"), F.lit(AFTER)).alias("after"), "path", "label")


def fit(findings: DataFrame, words: DataFrame, weights: list[float], most: int = FIT, trees: int = 24, depth: int = 8, seed: int = 7) -> RandomForestClassificationModel:
    """The forest; of more than ``most`` findings, those of the smallest hashes are used. Rows without a label are left out."""
    rows = findings.filter("label is not null").orderBy(F.xxhash64("candidate", "before", "after"), "candidate").limit(most)
    described_rows = assembled(described(rows, words, weights)).select("features", F.col("label").cast("double").alias("label"), "candidate", "before", "after")
    # one order and one part, so that the seed always deals the same rows; a table, as fitting passes over it several times
    table = cut(described_rows.orderBy(F.xxhash64("candidate", "before", "after"), "candidate").coalesce(1), "training")
    return RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed).fit(table)


def assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="features", handleInvalid="keep").transform(rows)


def secrets(docs: DataFrame, findings: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """doc_id, at, candidate, before, after, probability of each candidate in ``docs`` (doc_id, text, and source if there) that stays.

    A null or empty text has none; texts and candidates of any length are whole; rows are judged one by one, so repeated
    rows agree and nothing is tied. Other columns, whatever their names, are ignored; an empty table gives no rows.
    """
    words = cut(vocabulary(docs), "vocabulary")
    weights = pair_weights(words)
    model = fit(made_findings(docs.sparkSession) if findings is None else findings, words, weights)
    found = cut(candidates(docs), "candidates")
    judged = model.transform(assembled(described(found, words, weights))).withColumn("probability", F.round(vector_to_array("probability")[1], 6))
    return judged.filter(F.col("probability") >= least).select("doc_id", "at", "candidate", "before", "after", "probability")


def secret_report(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """doc_id, at, length, fingerprint (of the secret, which is not shown), probability of each secret."""
    return secrets(docs, findings).select("doc_id", F.col("at").cast("int").alias("at"), F.length("candidate").alias("length"), F.substring(F.sha2("candidate", 256), 1, 16).alias("fingerprint"), "probability")
