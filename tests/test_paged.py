import json
import threading
import urllib.parse
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from sparkwright.sources import paged as P

QUICK = {"backoff": "0.01", "longest": "0.05"}


class Store:
    """Items to list, events by id, what was asked; every third request fails first, in one of several ways."""

    def __init__(self):
        self.items = [{"id": f"i{n:03d}", "source": "ANNOTATION" if n % 3 else "API", "at": f"2024-01-{1 + n % 28:02d}", "n": n} for n in range(257)]
        self.asked, self.events, self.times, self.batches, self.failing, self.refused = [], {}, {}, [], True, None
        self.lock = threading.Lock()


@pytest.fixture
def server():
    store = Store()
    tried = {}

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args):
            pass

        def reply(self, code, value, headers=()):
            data = json.dumps(value).encode()
            self.send_response(code)
            for k, v in headers:
                self.send_header(k, v)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def fails(self):
            with store.lock:
                n = tried[self.path] = tried.get(self.path, 0) + 1
                kind = len(tried) % 9
            if not store.failing or n > 1 or kind % 3:
                return False
            if kind == 0:
                self.reply(503, {"error": "later"}, [("Retry-After", "0")])
            elif kind == 3:
                self.reply(429, {"error": "slower"})
            else:
                self.connection.close()
            return True

        def do_GET(self):
            url = urllib.parse.urlsplit(self.path)
            q = dict(urllib.parse.parse_qsl(url.query))
            with store.lock:
                store.asked.append((url.path, q))
            if url.path == "/gone":
                return self.reply(404, {"error": "no such list"})
            if url.path == "/broken":
                return self.reply(400, {"error": "bad request"})
            if self.fails():
                return None
            if url.path == "/hourly":
                if "models" in q:
                    return self.reply(400, {"error": "no such model"})
                return self.reply(200, {"place": q["lat"], "hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "temperature": [float(q["lat"]), None], "rain": [0.5]}})
            size = int(q["limit"])
            items = [x for x in store.items if all(str(x[k]) == q[k] for k in ("source",) if k in q)]
            if url.path == "/cursor":
                items = [x for x in items if q.get("from", "") <= x["at"] < q.get("to", "9")]
                start = int(q.get("cursor", 0))
                more = str(start + size) if start + size < len(items) else None
                return self.reply(200, {"data": items[start : start + size], "meta": {"cursor": more}})
            page = int(q["page"])
            return self.reply(200, {"data": items[(page - 1) * size : page * size], "meta": {"totalPages": -(-len(items) // size)}})

        def do_POST(self):
            batch = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["batch"]
            with store.lock:
                if store.refused and any(e["body"].get("g") == store.refused for e in batch):
                    return self.reply(400, {"error": "not this one"})
                store.batches.append(batch)
                for e in batch:
                    store.times[e["id"]] = store.times.get(e["id"], 0) + 1
                    store.events[e["id"]] = e["body"]
            return self.reply(200, {"errors": []})

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    store.url = f"http://127.0.0.1:{http.server_port}"
    yield store
    http.shutdown()


def items(df):
    return sorted(json.loads(r["item"])["n"] for r in df.collect())


def test_pages_are_whole_and_come_once(spark, server):
    df = P.paged(spark, f"{server.url}/pages", page_size=10, partitions=5, **QUICK)
    assert df.rdd.getNumPartitions() == 5
    assert items(df) == list(range(257)) and df.columns == ["place", "item_no", "item"]
    assert {q["page"] for _, q in server.asked} == {str(i) for i in range(1, 27)}


def test_cursor_one_list_or_one_a_range(spark, server):
    assert items(P.paged(spark, f"{server.url}/cursor", mode="cursor", page_size=20, **QUICK)) == list(range(257))
    ranges = P.paged(spark, f"{server.url}/cursor", mode="cursor", page_size=20, bounds=["2024-01-01", "2024-01-10", "2024-01-20", "2024-02-01"], **QUICK)
    assert ranges.rdd.getNumPartitions() == 3 and items(ranges) == list(range(257))


def test_old_servers_are_read_by_pages(spark, server):
    df = P.paged(spark, f"{server.url}/gone", mode="auto", fallback=f"{server.url}/pages", page_size=100, **QUICK)
    assert items(df) == list(range(257))
    with pytest.raises(Exception, match="bad request"):
        P.paged(spark, f"{server.url}/broken", mode="auto", fallback=f"{server.url}/pages", **QUICK).collect()
    assert len([1 for path, _ in server.asked if path == "/broken"]) == 1  # such a failure is not tried again


def test_equalities_reach_the_server(spark, server):
    df = P.paged(spark, f"{server.url}/pages", where={"source": "API"}, page_size=50, **QUICK)
    assert items(df) == list(range(0, 257, 3)) and {q.get("source") for _, q in server.asked} == {"API"}
    assert items(P.paged(spark, f"{server.url}/pages", where={"n": "7"}, **QUICK)) == [7]  # the server doesn't know this one


def test_series_by_place_without_what_the_server_refuses(spark, server):
    df = P.paged(spark, f"{server.url}/hourly", mode="each", requests=[{"lat": 41, "models": "m"}, {"lat": 42}, {"lat": 43, "models": "m"}], optional="models", **QUICK)
    assert df.rdd.getNumPartitions() == 3
    got = P.hourly_series(df, ["temperature", "rain", "snow"]).collect()
    assert sorted((r["place"], r["hour"].hour, r["temperature"], r["rain"], r["snow"]) for r in got if r["hour"].hour == 0) == [(str(i), 0, 41.0 + i, 0.5, None) for i in range(3)]
    assert len(got) == 6 and {(r["temperature"], r["rain"]) for r in got if r["hour"].hour == 1} == {(None, None)}
    with pytest.raises(Exception, match="no such model"):
        P.paged(spark, f"{server.url}/hourly", mode="each", requests=[{"lat": 41, "models": "m"}], **QUICK).collect()


def test_empty_list_moving_list_and_lasting_failure(spark, server):
    server.items = []
    assert P.paged(spark, f"{server.url}/pages", **QUICK).count() == 0
    rows = spark.createDataFrame([("1", 0, '{"id":"a"}'), ("2", 0, '{"id":"a"}'), ("2", 1, '{"id":"b"}')], P.READ_SCHEMA)
    assert sorted((r["place"], r["item"]) for r in P.once(rows).collect()) == [("2", '{"id":"a"}'), ("2", '{"id":"b"}')]
    with pytest.raises(Exception, match="HTTP 0"):
        P.paged(spark, "http://127.0.0.1:9/none", tries=2, **QUICK).collect()


def events(spark, groups=40):
    rows = [(f"t{g}", kind, f"{g}-{k}", json.dumps({"g": f"t{g}", "k": k})) for g in range(groups) for k, kind in enumerate(["trace", *["observation"] * (g % 7)])]
    return rows, spark.createDataFrame([*rows, rows[0]], "trace_id string, kind string, source_id string, body string")


def test_upload_keeps_groups_and_sends_ids_that_follow_from_the_event(spark, server):
    rows, df = events(spark)
    P.upload(df, f"{server.url}/in", "v1", limit=10, partitions=3, **QUICK)
    assert set(server.events) == {P.event_id("v1", kind, source) for _, kind, source, _ in rows}
    assert max(len(b) for b in server.batches) <= 10 and set(server.times.values()) == {1}
    where = {}
    for i, batch in enumerate(server.batches):
        for e in batch:
            where.setdefault(e["body"]["g"], set()).add(i)
    assert all(len(x) == 1 for x in where.values())
    assert len(server.batches) < 25


def test_an_upload_that_failed_is_repeated_without_doubles(spark, server):
    rows, df = events(spark)
    server.refused = "t33"
    with pytest.raises(Exception, match="not this one"):
        P.upload(df, f"{server.url}/in", "v1", limit=5, partitions=2, **QUICK)
    sent = len(server.events)
    assert 0 < sent < len(rows)
    server.refused = None
    P.upload(df, f"{server.url}/in", "v1", limit=5, partitions=2, **QUICK)
    assert len(server.events) == len(rows) and sorted(e["g"] for e in server.events.values()) == sorted(r[0] for r in rows)
    server.batches.clear()
    done = spark.createDataFrame([(f"t{g}",) for g in range(39)], "trace_id string")
    P.upload(df, f"{server.url}/in", "v1", done=done, **QUICK)
    assert {e["body"]["g"] for b in server.batches for e in b} == {"t39"}


def test_refuses_null_keys_and_other_columns(spark, server):
    with pytest.raises(ValueError, match="null"):
        P.upload(spark.createDataFrame([("t", None, "s", "{}")], "trace_id string, kind string, source_id string, body string"), f"{server.url}/in", "v1")
    spark.dataSource.register(P.PagedSource)
    with pytest.raises(Exception, match="columns are"):
        spark.range(1).write.format("paged").option("url", server.url).mode("append").save()


def test_ids_as_an_expression(spark):
    rows = [("trace", "ä-1"), ("observation", ""), ("x", "y" * 500)]
    got = spark.createDataFrame(rows, "k string, s string").select(P.event_id_of("v:1", F.col("k"), F.col("s"))).collect()
    assert [r[0] for r in got] == [str(uuid.uuid5(uuid.NAMESPACE_URL, f"v:1:{k}:{s}")) for k, s in rows]


def test_scores_become_annotations_and_sides_are_compared(spark):
    scores = [{"id": "s1", "name": "quality", "value": 0.5, "dataType": "NUMERIC", "source": "ANNOTATION", "timestamp": "2024-01-02T00:00:00Z", "authorUserId": "u", "subject": {"kind": "TRACE", "id": "t1"}, "metadata": {"a": 1}},
              {"id": "s2", "value": True, "source": "API", "createdAt": "2024-01-03T00:00:00Z", "subject": {"kind": "observation", "id": "o9", "traceId": "t1"}},
              {"id": "s3", "name": "n", "source": "API", "subject": {"kind": "session", "id": "gone"}}, {"id": "s4", "name": "n", "subject": {"kind": "dataset", "id": "d"}}, {"id": "s5", "name": "n", "subject": {"kind": "trace"}}, {"id": "s6"}]
    df = P.scores_to_annotations(spark.createDataFrame([(json.dumps(s),) for s in scores], "item string"))
    got = {r["target_id"]: r for r in df.collect()}
    assert set(got) == {"t1", "o9", "gone"}
    a, b = got["t1"], got["o9"]
    assert (a["trace_id"], a["annotator_type"], a["labeled_at"], a["ingested_at"]) == ("t1", "human", "2024-01-02T00:00:00Z", "2024-01-02T00:00:00Z")
    assert json.loads(a["label_json"]) == {"score_name": "quality", "score_value": "0.5", "score_data_type": "NUMERIC"}
    assert (b["trace_id"], b["annotator_id"], b["annotator_type"], json.loads(b["label_json"])["score_name"], b["labeled_at"]) == ("t1", "user-unknown", "imported", "unnamed_score", "2024-01-03T00:00:00Z")
    one = lambda name, value: spark.createDataFrame([(value,)], f"{name} string")
    kept = P.belonging(df, one("trace_id", "t1"), one("observation_id", "o1"), one("session_id", "s1"))
    assert sorted(r["target_id"] for r in kept.collect()) == ["o9", "t1"] and len({r["annotation_id"] for r in kept.collect()}) == 2
    left, right = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "id string"), spark.createDataFrame([("b",), ("c",)], "id string")
    r = P.reconciled(left, right, "id").first()
    assert (r["local"], r["remote"], r["missing"], r["missing_examples"], r["unexpected_examples"], r["exact_match"]) == (2, 2, 1, ["a"], ["c"], False)
    assert P.reconciled(left, left, "id").first()["exact_match"]
