import gzip
import random

import pyarrow.parquet as pq

from citeloom.llm import warc


def whole(rows):
    return b"".join(warc.record(*r) for r in rows)


ROWS = [(i, f"http://x/{i}", random.Random(i).randbytes(i * 37) + b"\r\n\r\nWARC/1.0\r\n\r\n") for i in range(40)] + [(None, None, b""), (3, "http://x/3", b"a" * 3_000_000)]


def check(tmp_path, data, rows, statuses=()):
    source, target = tmp_path / "in.warc.gz", tmp_path / "out" / "in.warc.gz"
    source.write_bytes(data)
    index = warc.normalise_file(f"file://{source}", f"file://{target}")
    assert [r["status"] for r in index if r["status"] != "ok"] == list(statuses)
    assert pq.read_table(f"{target}.idx.parquet").to_pylist() == index
    good = [r for r in index if r["status"] == "ok"]
    assert len(good) == len(rows)
    with open(target, "rb") as f:
        for r, (_, url, body) in reversed(list(zip(good, rows))):  # in any order
            head, content = warc.read_record(f, r["offset"], r["length"])
            assert warc.payload(content) == body and head.get("warc-target-uri") == url
            f.seek(r["offset"])
            assert gzip.decompress(f.read(r["length"])).endswith(body + b"\r\n\r\n")
    assert gzip.decompress(target.read_bytes()) == whole(rows) if target.stat().st_size else not rows


def test_one_stream_many_members_and_plain(tmp_path):
    check(tmp_path, gzip.compress(whole(ROWS)), ROWS)
    check(tmp_path, b"".join(gzip.compress(whole([r])) for r in ROWS), ROWS)
    check(tmp_path, whole(ROWS), ROWS)
    check(tmp_path, b"", [])


def test_broken_files_keep_what_is_before(tmp_path):
    check(tmp_path, gzip.compress(whole(ROWS[:5]) + whole(ROWS[5:6])[:-30]), ROWS[:5], ["truncated"])
    check(tmp_path, gzip.compress(whole(ROWS[:5]) + b"nonsense\r\n\r\n"), ROWS[:5], ["malformed"])
    cut = gzip.compress(whole(ROWS[:30]), mtime=0)
    source = tmp_path / "cut.warc.gz"
    source.write_bytes(cut[: len(cut) // 2])
    index = warc.normalise_file(f"file://{source}", f"file://{tmp_path}/o/cut.warc.gz")
    assert index[-1]["status"] == "truncated" and all(r["status"] == "ok" for r in index[:-1])


def test_pages_round_trip(spark):
    rows = [(1, "http://a", "<p>é</p>", "x"), (1, "http://a", "<p>é</p>", "y"), (2, None, "b" * 70_000, None), (None, "http://c", None, "z"), (4, "", "", "w")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, file string")
    index = warc.page_index(df).collect()
    assert len(index) == 5 and all(r.status == "ok" for r in index)
    back = warc.read_back(warc.pages_normalised(df)).collect()
    want = [(p, u, h or "") for p, u, h, _ in rows]
    assert sorted(map(tuple, back), key=str) == sorted(want, key=str)
    assert warc.page_index(df.limit(0)).count() == 0
