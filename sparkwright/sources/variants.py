"""JSON lines whose fields hold values of several kinds, as VARIANT: nothing is coerced, a bad line is named by its number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ["annotation_id", "target_type", "target_id", "label_schema_version", "label_json", "annotator_id", "annotator_type", "labeled_at", "ingested_at", "source", "supersedes_annotation_id", "retracted"]
ANNOTATORS = ["human", "llm", "rule", "imported"]


def json_rows(spark: SparkSession, path: str) -> DataFrame:
    """file, block, id, line and row (a variant; null where the line is no JSON) of each line that is not blank."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    return lines.withColumn("row", F.try_parse_json("line"))


def objects(spark: SparkSession, path: str) -> DataFrame:
    """The column ``row`` of the objects of JSON lines; raises with file and number of the first line that is none.

    Lines are numbered within their block of a file in parallel; only the blocks' sizes before the bad line are summed.
    """
    rows = json_rows(spark, path)
    blank = F.btrim("line", F.lit(" \t\r\n")) == ""
    good = F.coalesce(kind(F.col("row")) == "object", F.lit(False))
    bad = rows.filter(~blank & ~good).agg(F.min(F.struct("file", "block", "id")).alias("at")).first()["at"]
    if bad:
        before = rows.filter((F.col("file") == bad["file"]) & ((F.col("block") < bad["block"]) | (F.col("block") == bad["block"]) & (F.col("id") <= bad["id"])))
        raise ValueError(f"expected an object at {bad['file']}:{before.count()}")
    return rows.filter(~blank).select("row")


def at(row: Column, path: str) -> Column:
    return F.variant_get(row, path, "variant")


def kind(value: Column) -> Column:
    """boolean, number, string, array, object, null; a null column is missing (null)."""
    name = F.schema_of_variant(value)
    plain = F.when(name == "BOOLEAN", "boolean").when(name == "VOID", "null").when(name == "STRING", "string")
    return plain.when(name.startswith("ARRAY"), "array").when(name.startswith("OBJECT"), "object").when(name.isNotNull(), "number")


def boolean(row: Column, path: str) -> Column:
    """The value if it is a boolean; a text or a number is none."""
    return F.when(kind(at(row, path)) == "boolean", F.try_variant_get(row, path, "boolean"))


def number(row: Column, path: str, booleans: bool = False) -> Column:
    """The value if it is a number; with ``booleans`` true is 1 and false 0."""
    k = kind(at(row, path))
    own = F.when(k == "number", F.try_variant_get(row, path, "double"))
    return own.when(k == "boolean", F.try_variant_get(row, path, "boolean").cast("double")) if booleans else own


def text(row: Column, path: str) -> Column:
    return F.when(kind(at(row, path)) == "string", F.try_variant_get(row, path, "string"))


def absent(row: Column, path: str) -> Column:
    return at(row, path).isNull()


def empty(row: Column, path: str) -> Column:
    """Missing, null, false, zero, or without content."""
    v, k = at(row, path), F.coalesce(kind(at(row, path)), F.lit("null"))
    plain = F.coalesce(v.cast("string"), F.lit(""))
    return (k == "null") | (k == "boolean") & (plain == "false") | (k == "number") & (F.coalesce(number(row, path), F.lit(1.0)) == 0) | (k == "string") & (plain == "") | k.isin("array", "object") & F.to_json(v).isin("[]", "{}")


def moment(row: Column, path: str) -> Column:
    return F.try_to_timestamp(text(row, path))


def row_issues(row: Column) -> Column:
    """What is wrong with an annotation as it stands, whatever kinds its fields have: sorted reasons."""
    k = lambda path: F.coalesce(kind(at(row, path)), F.lit("missing"))
    kind_of_target, trace, target = text(row, "$.target_type"), at(row, "$.trace_id").cast("string"), at(row, "$.target_id").cast("string")
    confidence = number(row, "$.label_json.confidence", booleans=True)
    labeled, ingested = moment(row, "$.labeled_at"), moment(row, "$.ingested_at")
    reasons = {
        "invalid_target_type": ~F.coalesce(kind_of_target.isin("trace", "observation", "session"), F.lit(False)),
        "trace_target_mismatch": (kind_of_target == "trace") & ~trace.eqNullSafe(target),
        "session_target_has_trace_id": (kind_of_target == "session") & ~k("$.trace_id").isin("missing", "null"),
        "missing_annotator_id": empty(row, "$.annotator_id"),
        "invalid_annotator_type": ~F.coalesce(text(row, "$.annotator_type").isin(ANNOTATORS), F.lit(False)),
        "missing_label_schema_version": empty(row, "$.label_schema_version"),
        "missing_source": empty(row, "$.source"),
        "invalid_retracted_flag": k("$.retracted") != "boolean",
        "invalid_label_json": k("$.label_json") != "object",
        "invalid_confidence": (k("$.label_json") == "object") & ~k("$.label_json.confidence").isin("missing", "null") & ~F.coalesce((confidence >= 0) & (confidence <= 1), F.lit(False)),
        "invalid_timestamp": labeled.isNull() | ingested.isNull(),
        "ingested_before_labeled": ingested < labeled,
    }
    flags = [F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in reasons.items()] + [F.when(absent(row, f"$.{c}"), f"missing_field:{c}") for c in REQUIRED]
    return F.array_sort(F.array_compact(F.array(*flags)))


# on the given tables: labels become annotations whose fields change their kind from row to row

def as_annotations(labels: DataFrame) -> DataFrame:
    """doc_id and json: a line for each row of ``labels`` (doc_id, quality, toxic), of many kinds, some wrong."""
    i = F.col("doc_id")
    pick = lambda n, *texts: F.element_at(F.array(*[F.lit(t) for t in texts]), (F.pmod(F.floor(i / n), F.lit(len(texts))) + 1).cast("int"))
    label = F.concat(F.lit('{"quality":'), F.col("quality").cast("string"), pick(5, "", ',"confidence":0.5', ',"confidence":"0.5"', ',"confidence":true', ',"confidence":2', ',"confidence":null'), F.lit("}"))
    parts = [F.lit('{"annotation_id":"a'), i.cast("string"), F.lit('"'), pick(1, ',"target_type":"trace"', ',"target_type":"session"', ',"target_type":7'), F.lit(',"target_id":"t'), i.cast("string"), F.lit('"'),
        pick(3, "", ',"trace_id":null', ',"trace_id":"t1"'), F.when(i % 11 == 0, ',"label_json":"text"').otherwise(F.concat(F.lit(',"label_json":'), label)), pick(2, ',"label_schema_version":"v1"', ',"label_schema_version":""', ',"label_schema_version":0', ""),
        pick(7, ',"annotator_id":"u"', ',"annotator_id":false', ',"annotator_id":[]'), pick(4, ',"annotator_type":"human"', ',"annotator_type":"robot"', ',"annotator_type":null'), F.lit(',"labeled_at":"2024-01-02T00:00:00Z"'), pick(6, ',"ingested_at":"2024-01-03T00:00:00Z"', ',"ingested_at":"2024-01-01T00:00:00Z"', ',"ingested_at":5'),
        F.lit(',"source":"s","supersedes_annotation_id":null'), pick(1, ',"retracted":false', ',"retracted":"false"', ',"retracted":0', ',"retracted":true', ""), F.lit("}")]
    return labels.select("doc_id", F.concat(*parts).alias("json"))


def annotation_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's line with the kinds of its fields and what is wrong with it."""
    rows = as_annotations(spark.read.parquet(f"{sf_dir}/labels.parquet")).withColumn("row", F.parse_json("json"))
    k = lambda path: F.coalesce(kind(at(F.col("row"), path)), F.lit("missing"))
    return rows.select("doc_id", k("$.retracted").alias("retracted"), k("$.label_json.confidence").alias("confidence"), boolean(F.col("row"), "$.retracted").alias("is_retracted"), number(F.col("row"), "$.label_json.confidence", True).alias("sure"), F.array_join(row_issues(F.col("row")), ",").alias("issues"))


QUERIES = {"m_annotation_kinds": annotation_kinds}


def sql() -> str:
    pick = lambda n, *texts: "(['" + "', '".join(texts) + f"'])[CAST(doc_id // {n} % {len(texts)} AS INT) + 1]"
    j = lambda c: f"json_type(j, '$.{c}')"
    falsy = lambda c: f"coalesce({j(c)} = 'NULL' OR json_extract_string(j, '$.{c}') IN ('', 'false', '0', '[]', '{{}}'), true)"
    kinds = lambda c: f"CASE {j(c)} WHEN 'BOOLEAN' THEN 'boolean' WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'null' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'DOUBLE' THEN 'number' WHEN 'UBIGINT' THEN 'number' WHEN 'BIGINT' THEN 'number' ELSE 'missing' END"
    conf = "CASE json_type(j, '$.label_json.confidence') WHEN 'BOOLEAN' THEN CASE WHEN json_extract_string(j, '$.label_json.confidence') = 'true' THEN 1.0 ELSE 0.0 END WHEN 'VARCHAR' THEN NULL ELSE TRY_CAST(json_extract_string(j, '$.label_json.confidence') AS DOUBLE) END"
    time = lambda c: f"CASE WHEN {j(c)} = 'VARCHAR' THEN TRY_CAST(json_extract_string(j, '$.{c}') AS TIMESTAMPTZ) END"
    reasons = {
        "ingested_before_labeled": f"{time('ingested_at')} < {time('labeled_at')}",
        "invalid_annotator_type": f"coalesce({j('annotator_type')} <> 'VARCHAR' OR json_extract_string(j, '$.annotator_type') NOT IN ('human', 'llm', 'rule', 'imported'), true)",
        "invalid_confidence": f"{j('label_json')} = 'OBJECT' AND coalesce({j('label_json.confidence')}, 'NULL') <> 'NULL' AND NOT coalesce(({conf}) BETWEEN 0 AND 1, false)",
        "invalid_label_json": f"coalesce({j('label_json')} <> 'OBJECT', true)",
        "invalid_retracted_flag": f"coalesce({j('retracted')} <> 'BOOLEAN', true)",
        "invalid_target_type": f"coalesce({j('target_type')} <> 'VARCHAR' OR json_extract_string(j, '$.target_type') NOT IN ('trace', 'observation', 'session'), true)",
        "invalid_timestamp": f"({time('ingested_at')}) IS NULL OR ({time('labeled_at')}) IS NULL",
        "missing_annotator_id": falsy("annotator_id"),
        **{f"missing_field:{c}": f"{j(c)} IS NULL" for c in sorted(REQUIRED)},
        "missing_label_schema_version": falsy("label_schema_version"),
        "missing_source": falsy("source"),
        "session_target_has_trace_id": f"json_extract_string(j, '$.target_type') = 'session' AND coalesce({j('trace_id')}, 'NULL') <> 'NULL'",
        "trace_target_mismatch": f"json_extract_string(j, '$.target_type') = 'trace' AND json_extract_string(j, '$.trace_id') IS DISTINCT FROM json_extract_string(j, '$.target_id')",
    }
    flags = ", ".join(f"CASE WHEN {bad} THEN '{name}' END" for name, bad in reasons.items())
    label = "'{\"quality\":' || quality || " + pick(5, "", ',"confidence":0.5', ',"confidence":"0.5"', ',"confidence":true', ',"confidence":2', ',"confidence":null') + " || '}'"
    line = " || ".join(["'{\"annotation_id\":\"a' || doc_id || '\"'", pick(1, ',"target_type":"trace"', ',"target_type":"session"', ',"target_type":7'), "',\"target_id\":\"t' || doc_id || '\"'", pick(3, "", ',"trace_id":null', ',"trace_id":"t1"'), f"CASE WHEN doc_id % 11 = 0 THEN ',\"label_json\":\"text\"' ELSE ',\"label_json\":' || {label} END",
        pick(2, ',"label_schema_version":"v1"', ',"label_schema_version":""', ',"label_schema_version":0', ""), pick(7, ',"annotator_id":"u"', ',"annotator_id":false', ',"annotator_id":[]'), pick(4, ',"annotator_type":"human"', ',"annotator_type":"robot"', ',"annotator_type":null'), "',\"labeled_at\":\"2024-01-02T00:00:00Z\"'",
        pick(6, ',"ingested_at":"2024-01-03T00:00:00Z"', ',"ingested_at":"2024-01-01T00:00:00Z"', ',"ingested_at":5'), "',\"source\":\"s\",\"supersedes_annotation_id\":null'", pick(1, ',"retracted":false', ',"retracted":"false"', ',"retracted":0', ',"retracted":true', ""), "'}'"])
    return f"""WITH x AS (SELECT doc_id, CAST({line} AS JSON) AS j FROM labels) SELECT doc_id, {kinds('retracted')} AS retracted, {kinds('label_json.confidence')} AS confidence, CASE WHEN {j('retracted')} = 'BOOLEAN' THEN json_extract_string(j, '$.retracted') = 'true' END AS is_retracted, CAST({conf} AS DOUBLE) AS sure,
      coalesce(array_to_string(list_filter([{flags}], lambda r: r IS NOT NULL), ','), '') AS issues FROM x"""


SQL = {"m_annotation_kinds": sql()}
