"""The registered queries of this package and the SQL that checks them, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.llm.shared import arrow_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        arrow_batches(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer():
    """The byte-level tokenizer of the contract: the driver reads the rank file, tasks get it by broadcast."""
    import public_tokenizers

    from logsift.llm.byte_bpe import Bpe, read_ranks

    return Bpe(read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)


@query
def op7_byte_bpe(spark, d):
    from logsift.llm.byte_bpe import round_trip

    done = round_trip(table(spark, d, "documents").select("doc_id", "text"), tokenizer())
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op10_mixture(spark, d):
    from logsift.llm.mixture import mix, size_of
    from logsift.session import stored

    docs = table(spark, d, "documents")
    sized = stored(docs.select("doc_id", "source", size_of("text").alias("size")), "sizes")
    return mix(sized).documents.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "copies")


ORACLES["op10_mixture"] = r"""WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, CAST('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 6) AS BIGINT) AS cell FROM documents),
  s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS w FROM d GROUP BY source),
  level AS (SELECT 0 AS step, s.*, false AS capped, CAST(0 AS DOUBLE) AS unit FROM s
    UNION ALL (SELECT step + 1, source, n, w, capped OR u * w > 3 * n, u FROM
      (SELECT *, (sum(n) OVER () - coalesce(sum(CASE WHEN capped THEN 3 * n END) OVER (), 0)) / CAST(coalesce(sum(CASE WHEN NOT capped THEN w END) OVER (), 1) AS DOUBLE) AS u FROM level) WHERE step < 40)),
  t AS (SELECT source, n, CASE WHEN capped THEN CAST(3 * n AS DOUBLE) ELSE unit * w END AS target FROM level WHERE step = 40),
  p AS (SELECT *, CAST(round_even(target, 0) AS BIGINT) AS want FROM t),
  q AS (SELECT *, CASE WHEN n > 0 THEN want // n ELSE 0 END AS q, CASE WHEN n > 0 THEN want % n ELSE 0 END AS rest FROM p),
  c AS (SELECT source, cell, sum(size) AS m FROM d GROUP BY ALL),
  b AS (SELECT source, cell, m, coalesce(sum(m) OVER (PARTITION BY source ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM c)
  SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, q.n AS source_size, round(q.target, 6) AS target, CAST((q.q + CASE WHEN 2 * b.done + b.m < 2 * q.rest THEN 1 ELSE 0 END) * d.size AS BIGINT) AS taken, CAST(q.q + CASE WHEN 2 * b.done + b.m < 2 * q.rest THEN 1 ELSE 0 END AS BIGINT) AS copies
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source JOIN b ON b.source IS NOT DISTINCT FROM d.source AND b.cell = d.cell"""


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


@query
def op1_url_reputation(spark, d):
    """A page is labelled if the document whose number ends its path is: good if of good quality and not toxic."""
    from logsift.llm.url_reputation import filter_urls, url_path

    pages = table(spark, d, "pages").select("page_id", "url")
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    number = F.expr("try_cast(nullif(doc, '') AS BIGINT)")
    shown = pages.select("url", F.regexp_extract(url_path("url"), r"([0-9]+)(\.html)?/?$", 1).alias("doc")).select("url", number.alias("doc_id"))
    return filter_urls(pages, shown.join(labels, "doc_id", "left").select("url", "good"), URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict", "labelled", "good")


def _worth_sql(name: str, units: str, n: str, k: str, pn: str, pk: str, parents: str) -> str:
    return f"""{name}_x AS (SELECT count(*) AS g, count(DISTINCT {parents}) AS p, CAST(sum({n}) AS DOUBLE) AS n, sum({n} * power({k} / {n} - {pk} / {pn}, 2)) AS b, sum({k} * (1 - {k} / {n})) AS w, sum(CAST({n} AS DOUBLE) * {n} / {pn}) AS sq FROM {units} WHERE {n} > 0),
  {name}_y AS (SELECT *, b / (g - p) AS ms_b, w / (n - g) AS ms_w, (n - sq) / (g - p) AS n0 FROM {name}_x WHERE g > p AND n > g),
  {name} AS (SELECT coalesce(max(1 / least(greatest(CASE WHEN ms_b + (n0 - 1) * ms_w > 0 THEN (ms_b - ms_w) / (ms_b + (n0 - 1) * ms_w) ELSE 0 END, 1 / 1001.0::DOUBLE), 0.5) - 1), 20) AS m FROM {name}_y)"""


_LAST = r"((?:" + "|".join(s.replace(".", r"\.") for s in ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz", "co.za", "com.cn")) + r")|[^.]+)$"
ORACLES["op1_url_reputation"] = rf"""WITH u AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
  l AS (SELECT doc_id, min(quality = 1 AND toxic = 0) AS good FROM labels GROUP BY doc_id),
  o AS (SELECT host, good FROM (SELECT host, TRY_CAST(nullif(regexp_extract(path, '([0-9]+)(\.html)?/?$', 1), '') AS BIGINT) AS doc_id FROM u) LEFT JOIN l USING (doc_id)),
  h AS (SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), '\.?(:[0-9]*)?$', '') AS bare, count(good) AS n, CAST(coalesce(sum(CAST(good AS INT)), 0) AS BIGINT) AS k FROM o GROUP BY host),
  hs AS (SELECT *, CASE WHEN regexp_matches(bare, '^[0-9.]+$|^\[') THEN 'ip' ELSE regexp_extract(bare, '(?:^|\.){_LAST}', 1) END AS suffix, CASE WHEN regexp_matches(bare, '^[0-9.]+$|^\[') THEN bare ELSE regexp_extract(bare, '(?:[^.]+\.)?{_LAST}', 0) END AS domain FROM h),
  ds AS (SELECT domain, suffix, CAST(sum(n) AS BIGINT) AS dn, CAST(sum(k) AS BIGINT) AS dk FROM hs GROUP BY ALL),
  ss AS (SELECT suffix, CAST(sum(dn) AS BIGINT) AS sn, CAST(sum(dk) AS BIGINT) AS sk FROM ds GROUP BY ALL),
  a AS (SELECT CAST(sum(sn) AS BIGINT) AS an, CAST(sum(sk) AS BIGINT) AS ak FROM ss),
  hd AS (SELECT * FROM hs JOIN ds USING (domain, suffix)), dd AS (SELECT * FROM ds JOIN ss USING (suffix)), sa AS (SELECT * FROM ss, a),
  {_worth_sql('mh', 'hd', 'n', 'k', 'dn', 'dk', '(domain, suffix)')}, {_worth_sql('md', 'dd', 'dn', 'dk', 'sn', 'sk', 'suffix')}, {_worth_sql('mz', 'sa', 'sn', 'sk', 'an', 'ak', 'an')},
  s2 AS (SELECT suffix, (sk + mz.m * (ak + 1) / (an + 2)) / (sn + mz.m) AS sm FROM ss, a, mz),
  d2 AS (SELECT domain, suffix, (dk + md.m * sm) / (dn + md.m) AS dm FROM ds JOIN s2 USING (suffix), md),
  h2 AS (SELECT host, n, k, mh.m + n AS total, (k + mh.m * dm) / (n + mh.m) AS rate FROM hs JOIN d2 USING (domain, suffix), mh),
  r AS (SELECT page_id, host, path, CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1' WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/' WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/' WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/' WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule FROM u)
  SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN an = 0 OR rate - 1.645 * sqrt(rate * (1 - rate) / (total + 1)) >= 0.65 THEN 'allow' ELSE 'block' END AS verdict, n AS labelled, k AS good
  FROM r JOIN h2 USING (host), a"""


@query
def op4_line_windows(spark, d):
    from logsift.llm.line_windows import remove_repeated_lines

    done = remove_repeated_lines(table(spark, d, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLES["op4_line_windows"] = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
  w AS (SELECT doc_id, pos, line, lead(line, 1) OVER x AS l2, lead(line, 2) OVER x AS l3 FROM l WINDOW x AS (PARTITION BY doc_id ORDER BY pos)),
  r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY line, l2, l3 ORDER BY doc_id, pos) > 1 AS later FROM w WHERE l3 IS NOT NULL),
  c AS (SELECT DISTINCT doc_id, pos + unnest([0, 1, 2]) AS pos FROM r WHERE later)
  SELECT d.doc_id, count(l.pos) AS n_lines, count(c.pos) AS n_removed, sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE c.pos IS NULL), '')) AS kept_sha256
  FROM documents d LEFT JOIN l USING (doc_id) LEFT JOIN c ON c.doc_id = l.doc_id AND c.pos = l.pos GROUP BY d.doc_id"""


@query
def op9_superkmers(spark, d):
    from logsift.llm.superkmers import remove_repeated_windows

    done = remove_repeated_windows(table(spark, d, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op9_superkmers"] = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
  w AS (SELECT doc_id, unnest(range(1, len(words) - 33)) AS pos, words FROM d WHERE len(words) >= 35),
  r AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY array_to_string(words[pos:pos + 34], ' ')) AS times FROM w),
  c AS (SELECT DISTINCT doc_id, pos + unnest(range(0, 35)) AS pos FROM r WHERE times > 1),
  k AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM d)
  SELECT d.doc_id, count(k.pos) AS n_words, count(c.pos) AS n_removed, sha256(coalesce(string_agg(k.word, ' ' ORDER BY k.pos) FILTER (WHERE c.pos IS NULL), '')) AS kept_sha256
  FROM d LEFT JOIN k USING (doc_id) LEFT JOIN c ON c.doc_id = k.doc_id AND c.pos = k.pos GROUP BY d.doc_id"""


@query
def op3_shingle_join(spark, d):
    from logsift.llm.shingle_join import jaccard_components

    return jaccard_components(table(spark, d, "documents").select("doc_id", "text"))


@query
def op6_toxic_cnn(spark, d):
    from logsift.llm.toxic_cnn import held_out, score, train

    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    done = score(docs, train(docs, table(spark, d, "labels")))
    return done.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "toxic")


@query
def op8_warc(spark, d):
    from logsift.llm.warc import plan_records, read_records, write_archives
    from logsift.session import new_folder

    folder = new_folder(spark, "warc")
    index = write_archives(plan_records(table(spark, d, "pages")), folder)
    return read_records(index, folder).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


# DuckDB has SHA-1 in hexadecimal only; base32 takes 5 bits at a time of the 160.
ORACLES["op8_warc"] = """WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
  g AS (SELECT hex, max(page_id) AS last FROM p GROUP BY hex),
  b AS (SELECT hex, string_agg(lpad(bin(CAST('0x' || substr(hex, i * 4 + 1, 4) AS INTEGER)), 16, '0'), '' ORDER BY i) AS bits FROM g, range(10) t(i) GROUP BY hex),
  e AS (SELECT hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(('0b' || substr(bits, j * 5 + 1, 5)) AS INTEGER) + 1, 1), '' ORDER BY j) AS digest FROM b, range(32) t(j) GROUP BY hex)
  SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = last OR last IS NULL THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM p JOIN g USING (hex) JOIN e USING (hex)"""


@query
def op5_graph_dedup(spark, d):
    from logsift.llm.graph_dedup import near_duplicates

    return near_duplicates(table(spark, d, "embeddings"))


@query
def op2_hamming_search(spark, d):
    """The 10 nearest by the signs of 64 components to every vector whose id is divisible by 50, among all others."""
    from logsift.llm.hamming_search import nearest, sign_codes
    from logsift.session import stored

    codes = stored(sign_codes(table(spark, d, "embeddings"), "vec_id", "embedding", 64), "codes")
    return nearest(codes, codes.where("id % 50 = 0"), 10, 64).withColumnRenamed("id", "vec_id")


ORACLES["op2_hamming_search"] = """WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, CAST(list_sum(list_transform(range(1, 65), lambda i: CAST((q.embedding[i] > 0) <> (e.embedding[i] > 0) AS INT))) AS INT) AS distance FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INT) AS rank FROM p) SELECT query_id, vec_id, distance, rank FROM r WHERE rank <= 10"""


@query
def op11_vector_codes(spark, d):
    from logsift.llm.vector_codes import compress

    return compress(table(spark, d, "embeddings").select("vec_id", "embedding", "label")).rows.drop("label")


def _codes_sql(rounds: int) -> str:
    near = "list_sum(list_transform(range(1, 9), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i])))"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT part, vec_id, label, v, e, dist FROM (SELECT p.part, p.vec_id, p.label, p.v, c.e, {near} AS dist FROM p JOIN c{r} c ON c.part = p.part) QUALIFY row_number() OVER (PARTITION BY part, vec_id ORDER BY dist, e) = 1)")
        if r < rounds:
            steps.append(f"m{r} AS (SELECT part, e, list(f ORDER BY i) AS v FROM (SELECT part, e, i, CAST(floor(CAST(sum(v[i]) AS DOUBLE) / count(*)) AS BIGINT) AS f FROM a{r}, range(1, 9) t(i) GROUP BY part, e, i) GROUP BY part, e)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.part, c.e, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON m.part = c.part AND m.e = c.e)")
    return ", ".join(steps)


ORACLES["op11_vector_codes"] = f"""WITH k AS (SELECT vec_id, label, embedding FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
  p AS MATERIALIZED (SELECT vec_id, label, part, list_transform(embedding[part * 8 + 1:part * 8 + 8], lambda x: CAST(floor(CAST(x AS DOUBLE) * 4096) AS BIGINT)) AS v FROM k, range(8) t(part)),
  c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, v FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 16)),
  {_codes_sql(6)},
  r AS (SELECT vec_id, label, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a6 GROUP BY vec_id, label),
  s AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM r GROUP BY label),
  b AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c6)
  SELECT vec_id, code, error, label_error, codebooks_sha256 FROM r JOIN s ON r.label IS NOT DISTINCT FROM s.label, b"""


@query
def op12_quality_trees(spark, d):
    from logsift.llm.quality_trees import COUNTS, judge, train

    docs = table(spark, d, "documents").select("doc_id", "text")
    return judge(docs, train(docs, table(spark, d, "labels"))).select("doc_id", *COUNTS, "base_failed", "kept", "score")


@query
def op13_conversation_repair(spark, d):
    from logsift.llm.conversation_repair import damage, repair

    return repair(damage(table(spark, d, "conversations")), copies="copies").summary
