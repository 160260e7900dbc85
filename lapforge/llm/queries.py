"""The numbered operators over their whole tables."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from lapforge.llm import manifest, merkle, minhash, mixing, packing, sharding, spelling, suffixes, tokens, topk, toxicity, urls, warc
from lapforge.llm.common import table

QUERIES, ORACLES = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


# Dated list entries and fetch times that follow from the pages themselves: one page in six names a pattern, at three
# moments of its own. The same text runs in both engines but for the functions of addresses.
MOMENT = "TIMESTAMP '2024-01-01 00:00:00' + (page_id * 7919 + {k} * 104729) % 525600 * INTERVAL '1' MINUTE"


def list_entries(pages: DataFrame) -> DataFrame:
    u, i = F.col("url"), F.col("page_id")
    labels = F.split(urls.host_of(u), r"\.")
    site = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".")
    first = F.regexp_extract(urls.path_of(u), r"^/+([^/]+)", 1)
    pattern = (F.when(i % 36 == 0, F.concat(F.lit("domain:"), site)).when(i % 18 == 0, F.concat(F.lit("domain:"), urls.host_of(u)))
               .when(i % 12 == 0, F.concat(F.lit("path:"), urls.host_of(u), F.lit("/"), first)).otherwise(F.concat(F.lit("url:"), urls.address_of(u))))
    named = pages.where((i % 6 == 0) & (urls.host_of(u) != "")).select(pattern.alias("pattern"), "page_id")
    turns = [named.select("pattern", F.element_at(F.array(*map(F.lit, ("block", "allow", "lift", "block"))), (F.floor(i / 6) % 4 + 1 if k == 0 else
             (F.floor(i / 6) + k) % 4 + 1).cast("int")).alias("verdict"), F.expr(MOMENT.format(k=k)).alias("listed_at")) for k in range(3)]
    return turns[0].unionByName(turns[1]).unionByName(turns[2])


@query
def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.expr(MOMENT.format(k=5)))
    return urls.filter_urls(captures, list_entries(pages)).select("page_id", "fetched_at", "blocked", "matched", "listed_at")


_HOST = r"regexp_replace(regexp_replace(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '\.+$', '')"
ORACLES["op1_url_filter"] = rf"""
WITH p AS (SELECT page_id, url, {_HOST} AS host, regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(url, '^[^:/?#]+://[^/?#]*([^#]*)', 1) AS rest FROM pages),
l AS (SELECT *, string_split(host, '.') AS labels, list_filter(string_split(path, '/'), lambda x: x <> '') AS segments FROM p),
e AS (SELECT page_id, CASE WHEN page_id % 36 = 0 THEN 'domain:' || array_to_string(labels[greatest(len(labels) - 1, 1):], '.')
      WHEN page_id % 18 = 0 THEN 'domain:' || host WHEN page_id % 12 = 0 THEN 'path:' || host || '/' || regexp_extract(path, '^/+([^/]+)', 1)
      ELSE 'url:' || host || rest END AS pattern FROM l WHERE page_id % 6 = 0 AND host <> ''),
t AS (SELECT pattern, (['block', 'allow', 'lift', 'block'])[(page_id // 6 + k) % 4 + 1] AS verdict,
      TIMESTAMP '2024-01-01 00:00:00' + ((page_id * 7919 + k * 104729) % 525600) * INTERVAL '1' MINUTE AS listed_at FROM e, range(3) r(k)),
d AS (SELECT pattern, listed_at, arg_max(verdict, CASE verdict WHEN 'block' THEN 2 WHEN 'allow' THEN 1 ELSE 0 END) AS verdict FROM t GROUP BY 1, 2),
v AS (SELECT *, lead(listed_at) OVER (PARTITION BY pattern ORDER BY listed_at) AS until FROM d),
c AS (SELECT page_id, TIMESTAMP '2024-01-01 00:00:00' + ((page_id * 7919 + 5 * 104729) % 525600) * INTERVAL '1' MINUTE AS fetched_at, host, labels, segments, rest FROM l),
k AS (SELECT page_id, fetched_at, 'domain:' || array_to_string(labels[i:], '.') AS pattern, len(labels) - i + 1 AS rank FROM c, range(1, 130) r(i) WHERE i <= len(labels) AND host <> ''
  UNION ALL SELECT page_id, fetched_at, 'path:' || host || '/' || array_to_string(segments[:i], '/'), 1000 + i FROM c, range(1, 4) r(i) WHERE i <= len(segments) AND host <> ''
  UNION ALL SELECT page_id, fetched_at, 'url:' || host || rest, 2000 FROM c WHERE host <> ''),
h AS (SELECT page_id, fetched_at, arg_max({{'verdict': verdict, 'pattern': pattern, 'listed_at': listed_at}}, rank) AS hit
  FROM k JOIN v USING (pattern) WHERE listed_at <= fetched_at AND (until IS NULL OR fetched_at < until) AND verdict <> 'lift' GROUP BY 1, 2)
SELECT c.page_id, c.fetched_at, coalesce(hit.verdict = 'block', false) AS blocked, hit.pattern AS matched, hit.listed_at AS listed_at
FROM c LEFT JOIN h USING (page_id, fetched_at)
"""


@query
def op2_norm_bucket_topk(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    finite = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = e.where(finite).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 64)).alias("embedding"))
    return topk.top_products(whole, whole.where("vec_id % 20 = 0"), 20)


ORACLES["op2_norm_bucket_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query
def op3_rendezvous_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("grown_shard", sharding.shard_of([F.col("doc_id")], [1.0] * 41))
    out = sharding.shard_records(docs, ["doc_id"], 40, order=[F.xxhash64("text")])
    return out.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
                      F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
                      F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query
def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), tokenizer(), special_tokens=True).drop("ids")


@query
def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    records = warc.round_trip(table(spark, folder, "pages"))
    return records.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op8_merkle_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = merkle.with_next(docs, "doc_id", "text", "next_text")
    docs = docs.withColumn("edited_text", merkle.edited(F.col("text"), F.col("next_text")))
    trees = docs.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
                        *(merkle.tree(F.col(c)).alias(t) for c, t in (("text", "own"), ("edited_text", "edit"), ("next_text", "next"))))
    sets = trees.select("*", *(merkle.leaf_set(F.col(t)).alias(f"{t}_leaves") for t in ("own", "edit", "next")))
    return sets.select("doc_id", "n_chars", "edited_sha256", merkle.fingerprint(F.col("own")).alias("fingerprint"),
                       merkle.fingerprint(F.col("edit")).alias("edited_fingerprint"),
                       merkle.likeness(F.col("own_leaves"), F.col("edit_leaves")).alias("near_edited"),
                       merkle.likeness(F.col("own_leaves"), F.col("next_leaves")).alias("near_next"))


@query
def op9_weighted_mixing(spark: SparkSession, folder: str) -> DataFrame:
    documents, _ = mixing.mix(table(spark, folder, "documents"))
    return documents.select("doc_id", "size", "source_size", "target", "taken", "source")


@query
def op5_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = suffixes.kept_bytes(table(spark, folder, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op7_superminhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"))


@query
def op10_toxicity_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    index = toxicity.fit(docs, table(spark, folder, "labels"))
    out = toxicity.score(docs, index, ["doc_id"])
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")


def misspelt(doc_id, run):
    """One run in 199, by a checksum of document and run, loses a letter."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % 199 == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


@query
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, folder, "documents"), reading=misspelt))


@query
def op12_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = tokens.token_counts(table(spark, folder, "documents"), tokenizer())
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > tokens.LIMIT).alias("over_limit"), "n_pretokens", "n_whole")


@query
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    def leaf(n_chars):
        return manifest.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))

    n, tampered = F.col("n_chars"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    out = manifest.manifest(table(spark, folder, "documents"), "doc_id", "lang", leaf(n), F.when(tampered & n.isNotNull(), leaf(n + 1)))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


# The three trees of a document (its own, that of its edited text, that of the next one) as rows, then side by side.
ORACLES["op8_merkle_fingerprints"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text FROM d WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, substring(text, 1, length(text) - length(text) // 2) || substring(next_text, 1, length(text) // 2) AS edited FROM n),
t AS (SELECT doc_id, 'own' AS kind, text AS x FROM e UNION ALL SELECT doc_id, 'edit', edited FROM e UNION ALL SELECT doc_id, 'next', next_text FROM e),
l AS (SELECT doc_id, kind, list_transform(string_split(x, chr(10)), lambda line: list_transform(regexp_extract_all(line, '[^.,;:!?]{0,47}?[.,;:!?]|[^.,;:!?]{12,46}?[dgkmpy][ \t]|[^.,;:!?]{1,48}'), lambda p: md5(p))) AS lines FROM t),
p AS (SELECT doc_id, kind, list_transform(lines, lambda y: {'hash': md5(coalesce(array_to_string(y, ','), '')), 'leaves': list_transform(y, lambda z: z[1:8])}) AS p FROM l),
b AS (SELECT *, list_filter(range(1, len(p) + 1), lambda i: p[i].hash[1:1] < '4' OR i = len(p)) AS borders FROM p),
s AS (SELECT *, list_transform(borders, lambda z, k: p[coalesce(borders[k - 1], 0) + 1 : z]) AS runs FROM b),
h AS (SELECT doc_id, kind, list_distinct(flatten(list_transform(p, lambda q: q.leaves))) AS leaves, list_transform(runs, lambda run: {
    'hash': md5(array_to_string(list_transform(run, lambda q: q.hash), ',')),
    'below': array_to_string(list_transform(run, lambda q: coalesce(array_to_string(q.leaves, ''), '')), ',')}) AS nodes FROM s),
f AS (SELECT doc_id, kind, leaves, md5(array_to_string(list_transform(nodes, lambda z: z.hash), ',')) || ':'
    || array_to_string(list_transform(nodes, lambda z: z.hash[1:16] || '=' || z.below), ';') AS fingerprint FROM h)
SELECT e.doc_id, length(e.text) AS n_chars, sha256(edited) AS edited_sha256, o.fingerprint AS fingerprint, c.fingerprint AS edited_fingerprint,
  CASE WHEN len(o.leaves) + len(c.leaves) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(o.leaves, c.leaves)) / (len(o.leaves) + len(c.leaves)) END AS near_edited,
  CASE WHEN len(o.leaves) + len(x.leaves) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(o.leaves, x.leaves)) / (len(o.leaves) + len(x.leaves)) END AS near_next
FROM e JOIN f o ON o.doc_id = e.doc_id AND o.kind = 'own' JOIN f c ON c.doc_id = e.doc_id AND c.kind = 'edit' JOIN f x ON x.doc_id = e.doc_id AND x.kind = 'next'
"""


# CRC-32 bit by bit over the bytes of a text of code points below 2048.
CRC32 = """xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(flatten(list_transform(string_split({x}, ''),
    lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)] ELSE [192 + (unicode(ch) >> 6), 128 + (unicode(ch) & 63)] END)), lambda b: [b::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, b: xor(xor(c, b) >> 1, 3988292384::UBIGINT * (xor(c, b) & 1::UBIGINT))))"""

# Near words: a letter less is the other word, or both lose a letter at the same place and are equal then.
ORACLES["op11_spelling_variants"] = f"""
WITH RECURSIVE r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
g AS (SELECT id, run, id || ':' || run AS x, count(*) AS c FROM r GROUP BY 1, 2),
h AS (SELECT run, c, {CRC32.format(x="x")} AS h FROM g),
t AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substring(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, c FROM h),
w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM t WHERE length(word) >= 6 GROUP BY 1 HAVING sum(c) >= 5),
d AS (SELECT word, i, left(word, i - 1) || substring(word, i + 1) AS s FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
e AS (SELECT a.word AS a, b.word AS b FROM d a JOIN d b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, w.word FROM d JOIN w ON d.s = w.word UNION SELECT w.word, d.word FROM d JOIN w ON d.s = w.word),
b AS (SELECT a AS word, count(*) AS n_near, max(w.n) AS most, arg_min(b, {{'n': -w.n, 'b': encode(b)}}) AS form FROM e JOIN w ON w.word = e.b GROUP BY 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * w.n THEN form END AS form, CASE WHEN most >= 5 * w.n THEN most END AS form_n FROM w LEFT JOIN b USING (word)),
p AS (SELECT word, word AS at, form AS next FROM f UNION ALL SELECT p.word, f.word, f.form FROM p JOIN f ON f.word = p.next)
SELECT f.word, f.form, p.at AS root, f.n, f.n_near, f.form_n FROM f JOIN p ON p.word = f.word AND p.next IS NULL
"""


# Levels of the groups' trees (t) and of the tree over them (u), then each leaf's siblings and the way up of its claim (c, k).
_FIELDS = "concat({})".format(", ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "{n}", "text")))
ORACLES["op13_merkle_manifest"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '') AS g, sha256({_FIELDS.replace("{n}", "n_chars")}) AS leaf,
    sha256({_FIELDS.replace("{n}", "(n_chars + CASE WHEN " + CRC32.format(x="CAST(doc_id AS VARCHAR)") + " % 7 = 0 THEN 1 ELSE 0 END)")}) AS claimed FROM documents),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, claimed) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
t AS (SELECT g, 0 AS level, i, n, leaf AS h FROM l UNION ALL
  SELECT g, level + 1, i // 2, (n + 1) // 2, sha256(h || coalesce(lead(h) OVER (PARTITION BY g ORDER BY i), '')) FROM t WHERE n > 1 QUALIFY i % 2 = 0),
tops AS MATERIALIZED (SELECT g, h AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS level, i, n, subroot AS h FROM tops UNION ALL
  SELECT level + 1, i // 2, (n + 1) // 2, sha256(h || coalesce(lead(h) OVER (ORDER BY i), '')) FROM u WHERE n > 1 QUALIFY i % 2 = 0),
c AS (SELECT g, i, 0 AS level, n, claimed AS h, '' AS proof FROM l UNION ALL
  SELECT c.g, c.i, c.level + 1, (c.n + 1) // 2, sha256(CASE WHEN (c.i >> c.level) % 2 = 1 THEN t.h || c.h ELSE c.h || coalesce(t.h, '') END), proof || coalesce(t.h, '')
  FROM c LEFT JOIN t ON t.g = c.g AND t.level = c.level AND t.i = xor(c.i >> c.level, 1) WHERE c.n > 1),
k AS (SELECT c.g, c.i, tops.i AS at, 0 AS level, tops.n, c.h, c.proof FROM c JOIN tops ON tops.g = c.g WHERE c.n = 1 UNION ALL
  SELECT k.g, k.i, k.at, k.level + 1, (k.n + 1) // 2, sha256(CASE WHEN (k.at >> k.level) % 2 = 1 THEN u.h || k.h ELSE k.h || coalesce(u.h, '') END), proof || coalesce(u.h, '')
  FROM k LEFT JOIN u ON u.level = k.level AND u.i = xor(k.at >> k.level, 1) WHERE k.n > 1)
SELECT l.doc_id, l.leaf, tops.subroot, u.h AS root, sha256(k.proof) AS proof_sha256, k.h AS folded_root, k.h = u.h AS verified
FROM l JOIN k ON k.g = l.g AND k.i = l.i AND k.n = 1 JOIN tops ON tops.g = l.g JOIN u ON u.n = 1
"""

ORACLES["op6_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages), m AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to FROM m
"""

# All pairs that share a shingle, all documents that a document reaches.
ORACLES["op7_superminhash_dedup"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS root FROM d UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.id)
SELECT r.id AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id, min(root) = r.id AS kept FROM r LEFT JOIN n ON n.doc_id = r.id GROUP BY r.id
"""

# Bytes as pairs of hexadecimal digits; a byte goes if one of the 100 strings over it starts earlier, too.
ORACLES["op5_suffix_array_dedup"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, h, unnest(range(0, len(h) // 2)) AS i FROM d),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS x, CASE WHEN i + 100 <= len(h) // 2 THEN substr(h, 2 * i + 1, 200) END AS s FROM b),
f AS (SELECT doc_id, i, x, s IS NOT NULL AND row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 AS again FROM w),
g AS (SELECT doc_id, i, x, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS 99 PRECEDING) AS gone FROM f),
t AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM g),
k AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS r, count(*) FILTER (starts) AS spans, string_agg(x, '' ORDER BY i) FILTER (NOT gone) AS kept FROM t GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_bytes, coalesce(r, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
