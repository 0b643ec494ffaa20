"""Ranged reads and the file writer: what is read, what isn't, and what can't be."""

import http.server
import random
import threading

import pytest
from pyspark.sql import functions as F

from folioworks.sources import bytefiles as B


def test_ranges_are_slices_and_nothing_else_is_read(spark, tmp_path):
    r = random.Random(1)
    contents = {f"f{i}.bin": bytes(r.randrange(256) for _ in range(r.choice((0, 10, 5000)))) for i in range(12)}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    # a sparse file that no one could read whole in time
    with open(tmp_path / "huge.bin", "wb") as out:
        out.seek(300 << 30)
        out.write(b"end of it")
    asked = [(f"{tmp_path}/{name}?bytes={o},{n}", contents[name][o : None if n < 0 else o + n]) for name in contents for o, n in ((0, -1), (3, 4), (3, 4), (5, 0), (4000, 2000), (9000, 5), (2, -1))]
    asked += [(f"{tmp_path}/{name}", data) for name, data in contents.items()]
    asked += [(f"{tmp_path}/huge.bin?bytes={(300 << 30) + k},3", b"end of it"[k : k + 3]) for k in range(9)] + [(f"{tmp_path}/huge.bin?bytes={k << 30},2", b"\0\0") for k in range(0, 300, 10)]
    requests = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(asked)], "content_id int, path string").repartition(3)
    got = B.read_ranges(requests).collect()
    assert {(x.content_id, bytes(x.content)) for x in got} == {(i, data) for i, (_, data) in enumerate(asked)} and len(got) == len(asked)
    # no more than the gaps between near ranges of the small files besides
    assert sum(x.bytes_read for x in got if "huge" not in x.path) <= sum(len(data) for p, data in asked if "huge" not in p) + 5000 * len(contents)
    # nine ranges at the end of the file are one read
    assert sum(x.bytes_read for x in got if "huge" in x.path) == 9 + 60


def test_unreadable_ranges(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"abcdef")
    rows = [(None,), (f"{tmp_path}/gone",), (f"{tmp_path}/a?bytes=-2,3",), (f"{tmp_path}/a?bytes=2,3",), ("s3://other/k",)]
    stores = B.Stores({"own": f"file://{tmp_path}"}, "own")
    requests = spark.createDataFrame(rows, "path string").withColumn("error_of", F.lit("x")).coalesce(1)
    got = {x.path: (x.content and bytes(x.content), x.error and x.error.split(":")[0]) for x in B.read_ranges(requests, stores).collect()}
    assert got == {None: (None, None), rows[1][0]: (None, "FileNotFoundError"), rows[2][0]: (None, "ValueError"), rows[3][0]: (b"cde", None), rows[4][0]: (None, "KeyError")}
    with pytest.raises(Exception, match="No such file"):
        B.read_ranges(requests.where("path like '%gone'"), keep_errors=False).collect()
    assert B.read_ranges(requests.limit(0)).collect() == []


def test_buckets_have_places(spark, tmp_path):
    for bucket in ("one", "two"):
        (tmp_path / bucket / "in").mkdir(parents=True)
        (tmp_path / bucket / "in" / "k").write_bytes(f"0123 {bucket}".encode())
    stores = B.Stores({b: f"file://{tmp_path}/{b}" for b in ("one", "two")}, "two/in")
    rows = spark.createDataFrame([("s3://one/in/k?bytes=5,2",), ("s3a://two/in/k?bytes=5,-1",), ("k?bytes=1,2",)], "path string")
    assert {bytes(x.content) for x in B.read_ranges(rows, stores).collect()} == {b"on", b"two", b"12"}
    with pytest.raises(ValueError, match="default bucket"):
        B.Stores({"one": "file:///x"}, "three/in")


def test_web_ranges(spark, tmp_path):
    data, asked = bytes(range(256)) * 20, []

    class Server(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.headers.get("Range"))
            if self.path == "/plain" or not asked[-1]:
                self.send_response(200)
                part = data
            else:
                a, b = asked[-1].removeprefix("bytes=").split("-")
                part = data[int(a) : int(b) + 1 if b else None]
                self.send_response(206 if part else 416)
            self.send_header("Content-Length", str(len(part)))
            self.end_headers()
            self.wfile.write(part)

        def do_HEAD(self):
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    wanted = {f"{base}/a?bytes=7,3": data[7:10], f"{base}/a?bytes=5000,-1": data[5000:], f"{base}/a": data, f"{base}/plain?bytes=300,9": data[300:309], f"{base}/a?bytes=9999,2": b""}
    got = B.read_ranges(spark.createDataFrame([(p,) for p in wanted], "path string")).collect()
    assert {x.path: x.content and bytes(x.content) or b"" for x in got} == wanted and all(x.error is None for x in got)
    blocks = B.byte_blocks(spark, f"{base}/a", block=2000).where("offset = 2000").collect()
    assert [(x.offset, x.size, bytes(x.content)) for x in blocks] == [(2000, len(data), data[2000:4000])]
    assert "bytes=7-9" in asked and "bytes=2000-3999" in asked
    server.shutdown()


def test_blocks_are_a_partition_each_and_filters_choose_them(spark, tmp_path):
    for i in range(5):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.bin").write_bytes(bytes([65 + i]) * (100 * i))
    (tmp_path / "in" / "_hidden").write_bytes(b"x")
    rows = B.byte_blocks(spark, f"{tmp_path}/in", block=150)
    got = {(x.path.rpartition("/")[2], x.offset, x.length, x.size, bytes(x.content)) for x in rows.collect()}
    assert got == {(f"{i}.bin", at, min(150, 100 * i - at), 100 * i, bytes([65 + i]) * min(150, 100 * i - at)) for i in range(5) for at in range(0, 100 * i, 150)}
    assert rows.rdd.getNumPartitions() == len(got)
    few = rows.where((F.col("offset") >= 150) & F.col("path").endswith("3.bin") & F.col("content").isNotNull())
    assert few.rdd.getNumPartitions() == 1 and few.count() == 1
    assert rows.where("offset = 7").count() == 0
    one = B.byte_blocks(spark, [f"{tmp_path}/in/2.bin", f"{tmp_path}/in/4.bin"], offset=190, length=20).collect()
    assert [(x.length, bytes(x.content)) for x in one] == [(10, b"C" * 10), (20, b"E" * 20)]
    # blocks that aren't asked for aren't read: most of this file would not fit in memory
    with open(tmp_path / "huge", "wb") as out:
        out.truncate(1 << 40)
    assert [len(x.content) for x in B.byte_blocks(spark, f"{tmp_path}/huge", block=1 << 33).where(f"offset = {127 << 33}").select(F.substring("content", 1, 5).alias("content")).limit(0).collect()] == []
    assert B.byte_blocks(spark, f"{tmp_path}/huge", offset=(1 << 40) - 4).first().content == b"\0" * 4


def test_files_are_written_whole_where_the_rows_are(spark, tmp_path):
    rows = spark.range(40).select(F.concat(F.lit("d"), F.col("id") % 4, F.lit("/"), "id", F.lit(".bin")).alias("path"), F.when(F.col("id") != 7, F.repeat(F.lit("é"), F.col("id").cast("int"))).alias("content"), F.lit(1).alias("more"))
    for _ in range(2):  # again: the same files
        B.write_files(rows.repartition(5), str(tmp_path / "out"))
    found = {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert found == {f"d{i % 4}/{i}.bin": "é" * i * (i != 7) for i in range(40)}
    with pytest.raises(Exception, match="is no path below"):
        B.write_files(spark.createDataFrame([("../x", "y")], "path string, content string"), str(tmp_path / "out"))


def test_small_blocks_share_partitions(spark, tmp_path):
    for k in range(600):
        (tmp_path / f"{k}.bin").write_bytes(b"%06d" % k * 3)
    blocks = B.byte_blocks(spark, str(tmp_path), block=8)
    assert 64 <= blocks.rdd.getNumPartitions() < 100
    rows = blocks.orderBy("path", "offset").collect()
    assert len(rows) == 1800 and {r.length for r in rows} == {8, 2} and {r.size for r in rows} == {18}
    held = {}
    for r in rows:
        held[r.path] = held.get(r.path, b"") + bytes(r.content)
    assert sorted(held.values()) == [b"%06d" % k * 3 for k in range(600)]


def test_large_blocks_keep_partitions_of_their_own():
    whole = [B._Range("a", k << 26, 1 << 26, 10 << 26) for k in range(10)]
    assert [len(p.ranges) for p in B._packed(whole)] == [1] * 10
    assert B._packed([]) == []
