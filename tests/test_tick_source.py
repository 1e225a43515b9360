import http.server
import lzma
import threading
from datetime import UTC, datetime

import numpy as np
import pytest

from tidemark.sources import objects, tick_source

HOUR = 3_600_000_000
FIRST = tick_source.micros_of("2024-01-31T20:00:00")


def payload(k):
    record = np.zeros(3, objects.TICK_RECORD)
    record["ms"], record["ask"], record["bid"] = [0, 1_800_000, 3_599_999], 110_002 + k, 110_000 + k
    return lzma.compress(record.tobytes(), lzma.FORMAT_ALONE)


@pytest.fixture
def server():
    """Serves eight hours over a month's end; hour 2 does not exist, hour 5 fails twice before it comes."""
    asked, broken = [], {5: 2}
    of = {"/" + tick_source.object_url("", "EURUSD", FIRST + k * HOUR).lstrip("/"): k for k in range(8)}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            k = of.get(self.path)
            asked.append(k)
            if k is None or k == 2:
                return self.send_error(404)
            if broken.get(k, 0):
                broken[k] -= 1
                return self.send_error(503)
            body = b"" if k == 3 else payload(k)
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", asked, broken
    s.shutdown()


def read(spark, base, reader=None, **options):
    tick_source.register(spark)
    all_options = {"base": base, "symbol": "eur/usd", "start": "2024-01-31 20:00:00", "end": "2024-02-01 04:00:00", "attempts": "4", "backoff": "0"} | options
    return (reader or spark.read).format("tick_objects").options(**all_options).load()


def test_rows_of_all_hours(spark, server):
    base, asked, _ = server
    rows = sorted(read(spark, base).collect())
    assert len(rows) == 18 and sorted(set(asked)) == [*range(8)] and asked.count(5) == 3
    assert (rows[0]["ts"], rows[0]["ask"], rows[0]["bid"]) == (datetime(2024, 1, 31, 20), 1.10002, 1.1)
    assert rows[2]["ts"] == datetime(2024, 1, 31, 20, 59, 59, 999_000) and rows[3]["hour"] == datetime(2024, 1, 31, 21)
    cut = read(spark, base, start="2024-01-31 20:10:00", end="2024-01-31 21:30:00").collect()
    assert sorted(r["ts"].minute for r in cut) == [0, 30, 59]


@pytest.mark.parametrize("condition, hours, n", [
    ("ts >= '2024-01-31 23:30:00' AND ts < '2024-02-01 01:00:00'", {3, 4}, 3), ("hour = '2024-02-01 02:00:00'", {6}, 3), ("hour > '2024-02-01 02:00:00'", {6, 7}, 3),
    ("ts = '2024-01-31 21:30:00'", {1}, 1), ("ts < '2024-01-31 20:00:00'", set(), 0), ("ask > 1.10006 AND hour <= '2024-01-31 21:00:00'", {0, 1}, 0),
])
def test_filtered_read_asks_only_for_what_it_needs(spark, server, condition, hours, n):
    base, asked, _ = server
    assert read(spark, base).filter(condition).count() == n
    assert set(asked) == hours


def test_an_hour_that_cannot_be_had_fails_the_read(spark, server):
    base, asked, broken = server
    broken[5] = 1000
    with pytest.raises(Exception, match="503"):
        read(spark, base, attempts="2").count()
    assert read(spark, base).filter("hour < '2024-02-01 01:00:00'").count() == 9
    for bad in ({"end": "2024-01-31 20:00:00"}, {"symbol": "?"}):
        with pytest.raises(Exception, match="end must be after start|symbol"):
            read(spark, base, **bad).count()


def test_provenance(spark, server):
    base, *_ = server
    got = {r["hour"].hour: r for r in read(spark, base, rows="provenance", objects_per_partition="3").collect()}
    assert len(got) == 8 and got[22]["status"] == "missing" and got[22]["sha256"] is None
    assert (got[23]["status"], got[23]["bytes"], got[23]["ticks"]) == ("ok", 0, 0)
    assert got[0]["ticks"] == 3 and got[0]["url"].endswith("/EURUSD/2024/01/01/00h_ticks.bi5") and len(got[0]["sha256"]) == 64


def test_stream_goes_on_after_its_last_hour(spark, server, tmp_path):
    base, asked, _ = server

    def run(end):
        stream = read(spark, base, spark.readStream, end=end)
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(f"{tmp_path}/out").count()

    assert run("2024-01-31 22:00:00") == 6 and set(asked) == {0, 1}
    asked.clear()
    assert run("2024-02-01 04:00:00") == 18 and set(asked) == {2, 3, 4, 5, 6, 7}
    asked.clear()
    assert run("2024-02-01 04:00:00") == 18 and not asked
    hour = tick_source.TickStream({"base": base, "symbol": "EURUSD", "start": "2024-01-01", "delay_seconds": "60"}).latestOffset()["hour_us"]
    assert hour % HOUR == 0 and hour <= tick_source.micros_of(datetime.now(UTC)) - 60_000_000
