"""Deterministic sharded WARC writer, and a reader.

Records are dealt to shards by ranges of their key, sorted inside a shard, and each shard is rolled into files by
compressed size. Headers, lengths and digests are made anew from the payload. A file is written under a temporary name
and renamed when it is whole; the manifest, written last, names the files that count. The same rows give the same bytes,
so a task that runs twice renames equal files over each other. Of records with equal payloads the first is kept as a
response, the others are written as revisits that refer to it.
"""

import gzip
import hashlib
import uuid
import zlib
from urllib.parse import quote

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lapforge.session import fresh_path

FILE_BYTES = 16 << 20
ROWS_PER_SHARD = 5_000
BYTES_PER_SHARD = 32 << 20
READ_BYTES = 1 << 14
SPLIT_SAMPLE = 20_000
REVISIT_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _id(key) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'record {key}')}>"


def _head(first: str, fields: list[tuple[str, str]]) -> bytes:
    return "".join([first, "\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode()


def record(key, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One record as its own gzip member."""
    revisit = refers_to is not None
    http = _head("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))])
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _id(key)), ("WARC-Date", DATE)]
    if url:
        fields.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]")))
    fields += [("X-Key", "" if key is None else str(key)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload))),
               ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _id(refers_to)), ("X-Refers-To-Key", str(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return gzip.compress(_head("WARC/1.1", fields) + block + b"\r\n\r\n", 4, mtime=0)


def parsed(data: bytes):
    """(fields, block) of each record of an archive. A broken record raises ValueError."""
    view, at = memoryview(data), 0
    while at < len(view):
        member, texts = zlib.decompressobj(31), []
        while not member.eof:
            if at >= len(view):
                raise ValueError("truncated archive")
            texts.append(member.decompress(view[at:at + READ_BYTES]))
            at = min(at + READ_BYTES, len(view)) - len(member.unused_data)
        text = b"".join(texts)
        head, _, rest = text.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        block = rest[:int(fields["Content-Length"])]
        if not lines[0].startswith("WARC/") or rest[len(block):] != b"\r\n\r\n":
            raise ValueError("not a whole record")
        if hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"].removeprefix("sha256:"):
            raise ValueError("block digest differs")
        yield fields, block


def _files(uri: str):
    """A file system for a folder that all executors share, and the folder's path in it."""
    from pyarrow import fs
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def revisits(pages: DataFrame, key: str, payload: str, least: int = REVISIT_BYTES) -> DataFrame:
    """(key, digest, refers_to) of the records whose payload, of at least `least` bytes, a record with a smaller key has too."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    slim = pages.where(F.col(key).isNotNull() & (F.octet_length(body) >= least)).select(key, F.sha2(body, 256).alias("digest"))
    # pre-aggregated before the shuffle: very many copies of a payload send one row a task
    groups = slim.groupBy("digest").agg(F.min(key).alias("refers_to"), F.count("*").alias("copies")).where("copies > 1")
    return slim.join(groups, "digest").where(F.col(key) > F.col("refers_to")).select(key, "digest", "refers_to").distinct()


def splits(df: DataFrame, key: str, shards: int, rows: int, sample: int = SPLIT_SAMPLE) -> list:
    """shards - 1 split keys from the `sample` distinct keys of smallest hash: the same for the same rows, however they are partitioned.

    Only keys whose hash lies in the lowest part, four times as many as needed, leave their tasks."""
    if shards == 1:
        return []
    low = F.shiftrightunsigned(F.xxhash64(key), 11).cast("double") < min(1.0, 4 * sample / max(1, rows)) * 2.0 ** 53
    keys = df.where(F.col(key).isNotNull() & low).select(key).distinct().orderBy(F.xxhash64(key), key).limit(sample)
    ordered = sorted(r[0] for r in keys.collect())
    return [ordered[len(ordered) * i // shards] for i in range(1, shards)] if ordered else []


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html",
                   file_bytes: int = FILE_BYTES, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """Write pages as WARC files under folder; returns the manifest (file, shard, records, bytes, sha256), stored there too.

    Null payload: empty payload. Null url: no target. Null key: written last, with an empty key. Rows that repeat a key are
    records of their own; if it is the smallest key of their payload, all of them are responses. Empty table: no files.
    Other columns are not written. The keys are whole numbers.
    """
    size = pages.agg(F.count("*").alias("n"), F.sum(F.octet_length(payload)).alias("b")).first()
    shards = max(1, -(-size["n"] // rows_per_shard), -(-(size["b"] or 0) // BYTES_PER_SHARD))
    cuts = splits(pages, key, shards, size["n"])
    # One shuffle brings pages and marks of revisits to their shard; a key's marks stand before its pages.
    marks = revisits(pages, key, payload).withColumns({url: F.lit(None).cast("string"), payload: F.lit(None).cast("string")})
    rows = pages.select(key, url, payload).withColumns({"digest": F.lit(None).cast("string"), "refers_to": F.lit(None).cast(pages.schema[key].dataType)})
    rows = rows.unionByName(marks)

    def shard_of(batches):
        import pyarrow as pa
        edges = np.array(cuts, dtype=np.int64)
        for b in batches:
            keys = b.column(key)
            shard = np.searchsorted(edges, np.nan_to_num(keys.to_numpy(zero_copy_only=False)).astype(np.int64), side="right")
            shard = np.where(np.asarray(keys.is_null()), shards - 1, shard)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard, pa.int32())], names=[*b.schema.names, "shard"])

    dealt = rows.mapInArrow(shard_of, T.StructType([*rows.schema.fields, T.StructField("shard", T.IntegerType())]))
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", F.col(key).asc_nulls_last(), F.col("digest").asc_nulls_last(), url, F.xxhash64(payload))

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        files, root = _files(folder)
        attempt = f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        made, shard, number, parts, held, count = [], None, 0, [], 0, 0
        marked, marks = None, {}

        def roll():
            nonlocal number, parts, held, count
            if parts:
                data, name = b"".join(parts), f"shard-{shard:06d}-{number:05d}.warc.gz"
                files.create_dir(f"{root}/_temporary/{attempt}", recursive=True)
                with files.open_output_stream(f"{root}/_temporary/{attempt}/{name}", compression=None) as out:
                    out.write(data)
                files.move(f"{root}/_temporary/{attempt}/{name}", f"{root}/data/{name}")
                made.append((name, shard, count, len(data), hashlib.sha256(data).hexdigest()))
            number, parts, held, count = number + 1, [], 0, 0

        for b in batches:
            for k, u, text, digest, refers, s in zip(*(b.column(c).to_pylist() for c in (key, url, payload, "digest", "refers_to", "shard"))):
                if digest is not None:
                    marked, marks = k, {**(marks if k == marked else {}), digest: refers}
                    continue
                if s != shard:
                    roll()
                    shard, number = s, 0
                body = (text or "").encode()
                digest = hashlib.sha256(body).hexdigest()
                one = record(k, u, body, digest, marks.get(digest) if k == marked else None)
                if held and held + len(one) > file_bytes:
                    roll()
                parts.append(one)
                held, count = held + len(one), count + 1
        roll()
        if made:
            name, s, c, size, sha = zip(*made)
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(s, pa.int32()), pa.array(c, pa.int64()), pa.array(size, pa.int64()), pa.array(sha)],
                                             names=["file", "shard", "records", "bytes", "sha256"])

    files, root = _files(folder)
    files.create_dir(f"{root}/data", recursive=True)
    manifest = dealt.mapInArrow(write, "file string, shard int, records long, bytes long, sha256 string")
    manifest.write.parquet(f"{folder}/manifest")
    if files.get_file_info(f"{root}/_temporary").type.name == "Directory":
        files.delete_dir(f"{root}/_temporary")
    return pages.sparkSession.read.parquet(f"{folder}/manifest")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the files that the manifest names: key, url, record_type, refers_to, payload_bytes, payload_digest, payload (null for
    a revisit). Files are checked against the manifest, blocks and payloads against their digests."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(f"{folder}/data").select(
        F.element_at(F.split("path", "/"), -1).alias("found"), "content")
    kept = found.join(F.broadcast(manifest) if manifest.count() < 1_000_000 else manifest, F.col("found") == F.col("file"))
    schema = "key long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload string, file string"

    def read(batches):
        import pyarrow as pa
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for b in batches:
            for i in range(b.num_rows):
                name, data = b.column("file")[i].as_py(), b.column("content")[i].as_py()
                if hashlib.sha256(data).hexdigest() != b.column("sha256")[i].as_py():
                    raise ValueError(f"{name} differs from its manifest entry")
                rows = []
                for f, block in parsed(data):
                    body, digest = block.partition(b"\r\n\r\n")[2], f["WARC-Payload-Digest"].removeprefix("sha256:")
                    revisit = f["WARC-Type"] == "revisit"
                    if not revisit and (hashlib.sha256(body).hexdigest() != digest or len(body) != int(f["X-Payload-Length"])):
                        raise ValueError(f"payload digest differs in {name}")
                    rows.append((int(f["X-Key"]) if f["X-Key"] else None, f.get("WARC-Target-URI"), f["WARC-Type"],
                                 int(f["X-Refers-To-Key"]) if revisit else None, int(f["X-Payload-Length"]), digest, None if revisit else body.decode(), name))
                    if len(rows) == 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return kept.mapInArrow(read, schema)


def round_trip(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write pages, read the archives back."""
    folder = folder or fresh_path(pages.sparkSession, "llm-warc")
    write_archives(pages, folder, **options)
    return read_archives(pages.sparkSession, folder)
