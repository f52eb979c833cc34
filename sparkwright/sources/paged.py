"""Paged HTTP sources and batched uploads, by Spark's Python data sources.

Reading: a server that lists items by page number, or by cursor. Pages are dealt to partitions, which fetch them on the
executors with retries; a cursor can only be followed, so such a list is cut by a time range instead (one cursor a range).
Equalities that the server knows go to it as parameters. Each row is an item as JSON with the place it came from, so that a
page which a retried task reads again gives the same rows, and a list that grew while it was read can be told.

Writing: events in batches of whole groups, each with an id that follows from its content's key, so that whatever a lost
or repeated task sends again replaces what was there.
"""

from __future__ import annotations

import base64
import json
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

READ_SCHEMA = "place string, item_no int, item string"


def call(url: str, options: dict, body: dict | None = None) -> dict:
    """The JSON that ``url`` answers; failures that may pass (of the network, 408, 429, 5xx) are tried again, later each time.

    The second try comes after ``backoff`` seconds, then twice as many, at most ``longest``; a Retry-After of the server
    counts instead. The last failure is raised with what the server said.
    """
    tries, wait, longest = int(options.get("tries", 4)), float(options.get("backoff", 1.0)), float(options.get("longest", 10.0))
    headers = {"Accept": "application/json"}
    if options.get("user"):
        headers["Authorization"] = "Basic " + base64.b64encode(f"{options['user']}:{options.get('password', '')}".encode()).decode()
    data = None if body is None else json.dumps(body).encode()
    if data is not None:
        headers["Content-Type"] = "application/json"
    for attempt in range(1, tries + 1):
        pause = min(wait * 2 ** (attempt - 1), longest)
        try:
            with urllib.request.urlopen(urllib.request.Request(url, data, headers), timeout=float(options.get("timeout", 90))) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as e:
            if attempt == tries or not (e.code in (408, 429) or e.code >= 500):
                raise HttpError(e.code, url, e.read().decode("utf-8", "replace")) from e
            after = e.headers.get("Retry-After", "")
            pause = min(float(after), longest) if after.isdigit() else pause
        except (OSError, json.JSONDecodeError) as e:
            if attempt == tries:
                raise HttpError(0, url, str(e)) from e
        time.sleep(pause)
    raise AssertionError


class HttpError(RuntimeError):
    def __init__(self, code: int, url: str, said: str):
        super().__init__(f"HTTP {code} from {url}: {said[:500]}")
        self.code = code

    def __reduce__(self):  # it comes back from a Python worker by pickle
        return RuntimeError, (str(self),)


def path_of(answer: dict, path: str):
    for name in path.split("."):
        answer = (answer or {}).get(name)
    return answer


@dataclass
class Pages(InputPartition):
    """Pages from ``first`` up to ``last``, or one cursor's list within ``bounds``."""

    first: int
    last: int
    bounds: tuple[str, str] | None = None
    by: str = "page"


class PagedReader(DataSourceReader):
    """Options: ``url``; ``mode`` page, cursor, or auto (cursor, and pages where the server answers 404 to it); ``fallback``
    the url of the pages then; ``page_size``; ``partitions``; ``params`` (JSON) sent always; ``items``, ``total``, ``next``
    where the answer has its list, its number of pages and its cursor; ``bounds`` (JSON list of times) with ``from`` and
    ``to``, names of the parameters, to follow one cursor for each range. Mode each: one request for each of ``requests``
    (JSON list of parameters), the whole answer being its one item; where the server answers 400, once more without the
    parameters named in ``optional``.
    """

    def __init__(self, options: dict):
        self.options = dict(options)

    def url(self, by: str, **more) -> str:
        o = self.options
        base = o.get("fallback", o["url"]) if by == "page" and o.get("mode") == "auto" else o["url"]
        params = json.loads(o.get("params", "{}")) | {"limit": o.get("page_size", "100")} | {k: v for k, v in more.items() if v is not None}
        return base + ("&" if "?" in base else "?") + urllib.parse.urlencode(params)

    def partitions(self) -> list[Pages]:
        o, mode = self.options, self.options.get("mode", "page")
        if mode == "each":
            return [Pages(i, i + 1, by="each") for i in range(len(json.loads(o["requests"])))]
        if mode == "auto":
            try:
                call(self.url("cursor"), o)
                mode = "cursor"
            except HttpError as e:
                if e.code != 404:
                    raise
                mode = "page"
        if mode == "cursor":
            ends = json.loads(o.get("bounds", "[]"))
            return [Pages(0, 0, (a, b), "cursor") for a, b in zip(ends[:-1], ends[1:], strict=True)] or [Pages(0, 0, None, "cursor")]
        if mode != "page":
            raise ValueError(f"mode is page, cursor, auto or each, not {mode}")
        total = int(path_of(call(self.url("page", page=1), o), o.get("total", "meta.totalPages")) or 0)
        parts = max(1, min(total, int(o.get("partitions", 8))))
        ends = [1 + total * i // parts for i in range(parts + 1)]
        return [Pages(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True) if b > a] or [Pages(1, 1)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        items = self.options.get("items", "data")
        if partition.by == "each":
            yield from self.rows(f"{partition.first}", [self.answer(json.loads(self.options["requests"])[partition.first])])
            return
        if partition.by == "page":
            for page in range(partition.first, partition.last):
                yield from self.rows(f"{page}", path_of(call(self.url("page", page=page), self.options), items))
            return
        cursor, seen, number = None, set(), 0
        bounds = dict(zip((self.options.get("from", "from"), self.options.get("to", "to")), partition.bounds, strict=True)) if partition.bounds else {}
        while True:
            answer = call(self.url("cursor", cursor=cursor, **bounds), self.options)
            yield from self.rows(f"{'/'.join(partition.bounds or ())}#{number}", path_of(answer, items))
            cursor, number = path_of(answer, self.options.get("next", "meta.cursor")), number + 1
            if not cursor:
                return
            if cursor in seen:
                raise RuntimeError(f"the server gave the cursor {cursor!r} twice")
            seen.add(cursor)

    def answer(self, params: dict) -> dict:
        o, params = self.options, json.loads(self.options.get("params", "{}")) | params
        optional = {n.strip() for n in o.get("optional", "").split(",")} & set(params)
        send = lambda p: call(o["url"] + ("&" if "?" in o["url"] else "?") + urllib.parse.urlencode(p), o)
        try:
            return send(params)
        except HttpError as e:
            if e.code != 400 or not optional:
                raise
            return send({k: v for k, v in params.items() if k not in optional})

    @staticmethod
    def rows(place: str, items: list | None) -> Iterator[tuple]:
        for i, item in enumerate(items or []):
            yield place, i, json.dumps(item, ensure_ascii=False, sort_keys=True)


class PagedSource(DataSource):
    """Format ``paged``: reads lists, writes batches of events."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        return BatchWriter(self.options, schema, overwrite)


def paged(spark: SparkSession, url: str, where: dict[str, str] | None = None, **options) -> DataFrame:
    """place, item_no and item (JSON) of a paged list.

    ``where`` are equalities that the server is asked for as parameters and that items are held against again, should it
    not know them. They are given here, not taken from filters: a source that was told a filter once keeps it for all
    later queries on the same DataFrame.
    """
    spark.dataSource.register(PagedSource)
    options["params"] = (options.get("params") or {}) | (where or {})
    texts = {k: v if isinstance(v, str) else json.dumps(v) for k, v in options.items()}
    rows = spark.read.format("paged").options(url=url, **texts).load()
    for name, value in (where or {}).items():
        rows = rows.filter(F.get_json_object("item", f"$.{name}") == value)
    return rows


def once(rows: DataFrame, ident: str = "$.id") -> DataFrame:
    """``rows`` of a paged list, each item once: a list that moves while its pages are read shows some of them twice."""
    key = F.coalesce(F.get_json_object("item", ident), F.md5("item"))
    return rows.groupBy(key.alias("key")).agg(F.max_by(F.struct(*rows.columns), F.struct("place", "item_no", "item")).alias("r")).select("r.*")


def hourly_series(answers: DataFrame, values: list[str], path: str = "hourly", time: str = "time") -> DataFrame:
    """place, hour and ``values`` of answers that hold parallel arrays under ``path``: a row for each time.

    Arrays that are missing, or shorter than the times, give nulls; an answer without times gives no rows.
    """
    arrays = ", ".join(f"`{v}`:array<double>" for v in values)
    body = F.from_json("item", f"struct<`{path}`:struct<`{time}`:array<string>, {arrays}>>")[path]
    each = answers.select("place", F.posexplode(body[time]).alias("at", "t"), body.alias("b"))
    return each.select("place", F.to_timestamp_ntz("t").alias("hour"), *[F.get(F.col("b")[v], F.col("at")).alias(v) for v in values])


# the upload

@dataclass
class Sent(WriterCommitMessage):
    partition: int
    groups: int
    events: int
    batches: int


def event_id(version: str, kind: str, source: str) -> str:
    """The same for the same event, whoever sends it and however often."""
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"{version}:{kind}:{source}"))


def event_id_of(version: str, kind: Column, source: Column) -> Column:
    """``event_id`` as an expression: SHA-1 of the name space and the name, with version and variant set."""
    name = F.concat_ws(":", F.lit(version), kind, source)
    digest = F.sha1(F.concat(F.lit(bytearray(uuid.NAMESPACE_URL.bytes)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))


class BatchWriter(DataSourceWriter):
    """Rows (group_id, event_id, event as JSON), a partition's groups together: batches of at most ``limit`` events that
    never split a group (a larger group is a batch of its own). What the server refuses raises.
    """

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        if overwrite:
            raise ValueError("an upload only appends")
        wanted = ["group_id", "event_id", "event"]
        if schema.names != wanted:
            raise ValueError(f"columns are {wanted}, not {schema.names}")
        self.options = dict(options)

    def write(self, iterator) -> Sent:
        from pyspark import TaskContext

        sent, waiting, group, at = Sent(TaskContext.get().partitionId(), 0, 0, 0), [], [], None
        limit = int(self.options.get("limit", 500))
        for row in iterator:
            if row[0] != at:
                self.close(sent, waiting, group, limit)
                group, at = [], row[0]
            group.append({"id": row[1], "body": json.loads(row[2])})
        self.close(sent, waiting, group, limit)
        self.send(sent, waiting)
        return sent

    def close(self, sent: Sent, waiting: list, group: list, limit: int) -> None:
        if group:
            if waiting and len(waiting) + len(group) > limit:
                self.send(sent, waiting)
            waiting.extend(group)
            sent.groups += 1

    def send(self, sent: Sent, waiting: list) -> None:
        if waiting:
            answer = call(self.options["url"], self.options, {"batch": waiting})
            if answer.get("errors"):
                raise RuntimeError(f"the server refused {answer['errors'][:5]}")
            sent.events, sent.batches = sent.events + len(waiting), sent.batches + 1
            waiting.clear()

    def commit(self, messages: list[Sent | None]) -> None:
        done = [m for m in messages if m]
        print(f"sent {sum(m.events for m in done)} events of {sum(m.groups for m in done)} groups in {sum(m.batches for m in done)} batches")

    def abort(self, messages: list[Sent | None]) -> None:
        """Nothing to take back: whatever was sent is sent again, under the same ids."""


def upload(events: DataFrame, url: str, version: str, group: str = "trace_id", kind: str = "kind", source: str = "source_id", body: str = "body", done: DataFrame | None = None, partitions: int = 8, **options) -> None:
    """Send each row of ``events`` (a group's id, kind, id, body as JSON) to ``url``, groups whole and in order of kind and id.

    ``done`` (with the group's column) names groups that are already there. Rows with a null group, kind or id are refused
    before anything is sent. Equal rows are sent once. A group's rows are brought together in one partition, so a group
    must be such that a batch holds it.
    """
    events.sparkSession.dataSource.register(PagedSource)
    bad = events.filter(F.col(group).isNull() | F.col(kind).isNull() | F.col(source).isNull() | F.col(body).isNull())
    if bad.limit(1).count():
        raise ValueError(f"{group}, {kind}, {source} and {body} must not be null")
    left = events if done is None else events.join(done.select(group), group, "left_anti")
    rows = left.select(F.col(group).cast("string").alias("group_id"), event_id_of(version, F.col(kind), F.col(source).cast("string")).alias("event_id"), F.col(body).alias("event"), F.col(kind).alias("k"), F.col(source).alias("s")).dropDuplicates(["group_id", "event_id"])
    placed = rows.repartition(partitions, "group_id").sortWithinPartitions("group_id", "k", "s").select("group_id", "event_id", "event")
    placed.write.format("paged").options(url=url, **{k: str(v) for k, v in options.items()}).mode("append").save()


# what the lists hold

SCORE = "id string, name string, value string, dataType string, source string, timestamp string, createdAt string, updatedAt string, authorUserId string, comment string, configId string, queueId string, environment string, projectId string, metadata string, subject struct<kind:string, id:string, traceId:string, trace_id:string>"


def scores_to_annotations(scores: DataFrame) -> DataFrame:
    """Annotations of a list of scores (its column item): those of a trace, an observation or a session with an id."""
    s = F.from_json("item", SCORE)
    x = scores.select(s.alias("s")).select("s.*")
    kind, manual = F.lower("subject.kind"), F.upper(F.coalesce("source", F.lit(""))) == "ANNOTATION"
    target = F.col("subject.id")
    label = F.to_json(F.struct(F.coalesce(F.when(F.col("name") != "", F.col("name")), F.lit("unnamed_score")).alias("score_name"), F.col("value").alias("score_value"), F.col("dataType").alias("score_data_type")), {"ignoreNullFields": "false"})
    more = F.to_json(F.struct(F.col("id").alias("score_id"), F.col("source").alias("score_source"), F.col("configId").alias("config_id"), F.col("queueId").alias("queue_id"), "environment", F.col("projectId").alias("project_id"), F.col("updatedAt").alias("updated_at"), F.coalesce("metadata", F.lit("{}")).alias("score_metadata")), {"ignoreNullFields": "false"})
    filled = lambda c, d: F.coalesce(F.when(F.col(c) != "", F.col(c)), d)
    return x.filter(kind.isin("trace", "observation", "session") & target.isNotNull() & (target != "")).select(
        F.concat(F.lit("ann-"), F.substring(F.sha2(F.concat(F.lit('"score"\x1f'), F.coalesce(F.to_json(F.struct("id")), F.lit("null"))), 256), 1, 24)).alias("annotation_id"), kind.alias("target_type"), target.alias("target_id"),
        F.when(kind == "trace", target).otherwise(F.coalesce("subject.traceId", "subject.trace_id")).alias("trace_id"), F.lit("score-v1").alias("label_schema_version"), label.alias("label_json"),
        filled("authorUserId", F.lit("user-unknown")).alias("annotator_id"), F.when(manual, "human").otherwise("imported").alias("annotator_type"), filled("timestamp", F.col("createdAt")).alias("labeled_at"), filled("createdAt", F.col("timestamp")).alias("ingested_at"),
        F.when(manual, "manual-annotation").otherwise("score").alias("source"), F.lit(None).cast("string").alias("supersedes_annotation_id"), F.lit(False).alias("retracted"), "comment", more.alias("metadata"))


def belonging(annotations: DataFrame, traces: DataFrame, observations: DataFrame, sessions: DataFrame) -> DataFrame:
    """Annotations whose target, or an observation's trace, is in the tables."""
    own = lambda df, c, kind: df.select(F.col(c).alias("target_id"), F.lit(kind).alias("target_type")).distinct()
    targets = own(traces, "trace_id", "trace").unionByName(own(observations, "observation_id", "observation")).unionByName(own(sessions, "session_id", "session"))
    direct = annotations.join(targets, ["target_id", "target_type"], "left_semi")
    by_trace = annotations.join(targets, ["target_id", "target_type"], "left_anti").filter("target_type = 'observation'").join(traces.select("trace_id").distinct(), "trace_id", "left_semi")
    return direct.unionByName(by_trace.select(*direct.columns))


def reconciled(local: DataFrame, remote: DataFrame, key: str, examples: int = 20) -> DataFrame:
    """One row: how many distinct keys each side has, how many the other lacks with the first of them, and exact_match."""
    both = local.select(F.col(key).alias("k"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(remote.select(F.col(key).alias("k"), F.lit(0).alias("l"), F.lit(1).alias("r")))
    keys = both.filter("k is not null").groupBy("k").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    total = keys.agg(F.coalesce(F.sum("l"), F.lit(0)).alias("local"), F.coalesce(F.sum("r"), F.lit(0)).alias("remote"), F.count_if(F.expr("l > r")).alias("missing"), F.count_if(F.expr("r > l")).alias("unexpected"))
    first = lambda c, name: keys.filter(c).orderBy("k").limit(examples).agg(F.sort_array(F.collect_list("k")).alias(name))
    return total.join(first("l > r", "missing_examples"), how="cross").join(first("r > l", "unexpected_examples"), how="cross").withColumn("exact_match", (F.col("missing") == 0) & (F.col("unexpected") == 0))
