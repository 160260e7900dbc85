"""Archives: exact round trips, revisits, equal bytes on every run, damage found."""

import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from lapforge.llm import warc

SAME = "é" * 60  # 120 bytes
ROWS = [(1, "http://a/", SAME), (2, "http://a/é b\r\nx", SAME), (3, None, None), (4, "u", ""), (None, "n", SAME), (1, "http://a/", SAME), (5, "q", "short"),
        (6, "q", "short"), (2, "other", "y" * 200), (7, "l", "y" * 200), (8, "long", "long text\r\n\r\n" * 90_000), (9, None, "WARC/1.1\r\n\r\n"), (10, "z", "b" * 99), (11, "z", "b" * 99)]


def pages(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    return df.withColumns({c: F.lit("x") for c in ("shard", "digest", "refers_to", "payload", "key")})


def expected():
    first = {}
    for i, _, t in sorted((r for r in ROWS if r[0]), key=lambda r: r[0]):
        first.setdefault(t or "", i)
    out = []
    for i, _, t in ROWS:
        b = (t or "").encode()
        again = i is not None and len(b) >= 100 and first[t or ""] < i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[t or ""] if again else None, None if again else b.decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows,size", [(3, 700), (100, 1 << 20)])
def test_round_trip(spark, tmp_path, rows, size):
    got = warc.round_trip(pages(spark), f"file://{tmp_path}/w", rows_per_shard=rows, file_bytes=size)
    cols = ["key", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    assert sorted((tuple(r) for r in got.select(cols).collect()), key=repr) == expected()
    assert not os.path.exists(f"{tmp_path}/w/_temporary")


def test_same_rows_same_files_in_key_order(spark, tmp_path):
    def made(name, df):
        m = warc.write_archives(df, f"{tmp_path}/{name}", rows_per_shard=4, file_bytes=600).collect()
        files = {r["file"]: open(f"{tmp_path}/{name}/data/{r['file']}", "rb").read() for r in m}
        assert all(hashlib.sha256(files[r["file"]]).hexdigest() == r["sha256"] and len(files[r["file"]]) == r["bytes"] for r in m)
        return files
    a, b = made("a", pages(spark).repartition(3)), made("b", pages(spark).coalesce(1))
    assert a == b and len(a) > 4
    keys = [f["X-Key"] for n in sorted(a) for f, _ in warc.parsed(a[n])]
    assert keys == sorted(keys, key=lambda k: (k == "", int(k or 0)))
    text = gzip.decompress(a[min(a)]).decode()
    assert text.startswith("WARC/1.1\r\nWARC-Type: response\r\n") and "\nx" not in text.split("Content-Length")[0]


def test_damage_and_stray_files(spark, tmp_path):
    warc.write_archives(pages(spark), f"{tmp_path}/w")
    stray = gzip.compress(b"not in the manifest")
    (tmp_path / "w/data/shard-999999-00000.warc.gz").write_bytes(stray)
    assert warc.read_archives(spark, f"{tmp_path}/w").count() == len(ROWS)
    name = next(iter(os.listdir(tmp_path / "w/data")))
    data = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert [b for _, b in warc.parsed(data * 2)] == [b for _, b in warc.parsed(data)] * 2 and name
    with pytest.raises(ValueError):
        list(warc.parsed(data[:-5]))
    broken = gzip.compress(gzip.decompress(data).replace(b"payload\r\n\r\n", b"PAYLOAD\r\n\r\n"))
    with pytest.raises(ValueError):
        list(warc.parsed(broken))


def test_empty_table(spark, tmp_path):
    assert warc.round_trip(pages(spark).limit(0), f"{tmp_path}/w").count() == 0
