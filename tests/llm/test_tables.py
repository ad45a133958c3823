"""Searches, graphs, archives, mixtures and URL filters against brute force."""

import base64
import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from logsift.llm import graph_dedup, hamming_search, mixture, shared, url_reputation, warc
from logsift.session import new_folder


def test_components(spark):
    edges = [(i, i + 1) for i in range(40, 90)] + [(1, 5), (5, 3), (7, 7), (100, 2), (2, 100)] + [(500, 500 + i) for i in range(1, 60)]
    got = {r.node: r.component for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 40 for i in range(40, 91)}, 1: 1, 5: 1, 3: 1, 100: 2, 2: 2, **{500 + i: 500 for i in range(60)}}
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bitmap_misses_nothing(spark):
    values = np.random.default_rng(0).integers(-(1 << 62), 1 << 62, 3000)
    bits = shared.bitmap(spark.createDataFrame([(int(v),) for v in values[:1000]], "x long"), "x", 20)
    assert shared.in_bitmap(bits, values[:1000]).all() and shared.in_bitmap(bits, values).sum() < 1100


@pytest.mark.parametrize("bits,segment", [(64, 16), (64, 8), (128, 16), (40, 16)])
def test_nearest_codes(spark, bits, segment):
    rng = np.random.default_rng(bits)
    base = rng.normal(size=(12, bits))
    rows = [(i, (base[i % 12] + rng.normal(size=bits) * (0.3 if i % 3 else 3)).tolist()) for i in range(240)]
    rows += [(1000 + i, base[0].tolist()) for i in range(30)] + [(2000, None), (None, base[1].tolist()), (2001, [1.0]), (2002, [None] * bits), rows[5]]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    codes = hamming_search.sign_codes(df, "id", "v", bits)
    got = {(r.query_id, r["rank"]): (r.distance, r.id) for r in hamming_search.nearest(codes, codes.where("id % 20 = 0"), 7, bits, segment).collect()}
    signs = {i: tuple((x or 0) > 0 for x in v) for i, v in rows if i is not None and v and len(v) == bits}
    want = {}
    for q in (i for i in signs if i % 20 == 0):
        near = sorted((sum(a != b for a, b in zip(signs[q], signs[i])), i) for i in signs if i != q)[:7]
        want |= {(q, n + 1): x for n, x in enumerate(near)}
    assert got == want


def test_nearest_of_few(spark):
    df = spark.createDataFrame([(0, [1.0] * 64), (1, [-1.0] * 64)], "id long, v array<double>")
    codes = hamming_search.sign_codes(df, "id", "v", 64)
    assert [tuple(r) for r in hamming_search.nearest(codes, codes.where("id = 0"), 5, 64).collect()] == [(0, 1, 64, 1)]
    assert hamming_search.nearest(codes.where("false"), codes.where("false"), 5, 64).count() == 0


def test_near_duplicate_vectors(spark):
    rng, rows = np.random.default_rng(4), []
    for c in range(40):
        center = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 40))):
            rows.append((len(rows), (center + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.2])).tolist(), c % 3))
    rows += [(len(rows) + i, rows[0][1], rows[0][2]) for i in range(50)]
    odd = [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [math.nan] * 16, 1), (5003, [None] * 16, 1), (5004, rows[3][1], None), (5005, rows[3][1][:8], rows[3][2]), (5006, [math.inf] * 16, 1), (5007, [], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    settings = graph_dedup.GraphSettings(shard=120, sample=300)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in graph_dedup.near_duplicates(df, settings=settings).collect()}
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    link = (v @ v.T >= 0.93) & (label[:, None] == label) & ~np.eye(len(v), dtype=bool)
    assert all(got[i] == (0, i, True) for i, *_ in odd)
    found = sum(got[i][0] for i in range(len(rows)))
    assert found >= 0.95 * link.sum() and all(got[i][0] <= link[i].sum() for i in range(len(rows)))
    group = np.arange(len(v))
    for a, b in itertools.product(range(3), range(len(v))):
        group[b] = group[np.flatnonzero(link[b] | (np.arange(len(v)) == b))].min()
    for _ in range(60):
        group = np.array([group[np.flatnonzero(link[b] | (np.arange(len(v)) == b))].min() for b in range(len(v))])
    assert np.mean([got[i][1] == group[i] for i in range(len(rows))]) >= 0.97
    assert graph_dedup.near_duplicates(df.where("false")).count() == 0


def test_vectors_beyond_the_range_of_squares(spark):
    rows = [(1, [1e200, 1e200], 1), (2, [1e200, 1.01e200], 1), (3, [1e-200, 1e-200], 1), (4, [1.0, 1.0], 1), (5, [-1e300, 1e300], 1), (6, [5e-324, 0.0], 2), (7, [2.0, 0.0], 2), (8, [0.0, 0.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in graph_dedup.near_duplicates(df).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5), 6: (1, 6), 7: (1, 6), 8: (0, 8)}


def test_links_of_a_dense_group_are_whole(spark):
    rng = np.random.default_rng(8)
    center = rng.normal(size=16)
    rows = [(i, (center + rng.normal(size=16) * 0.15).tolist(), 1) for i in range(700)]
    rows += [(i, rows[i - 700][1], 1) for i in range(700, 720)] + [(i, rng.normal(size=16).tolist(), 2) for i in range(720, 760)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    settings = graph_dedup.GraphSettings(shard=40, sample=300, block=300)
    got = {r.vec_id: (r.n_links, r.component_id) for r in graph_dedup.near_duplicates(df, settings=settings).collect()}
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    link = (v @ v.T >= 0.93) & (label[:, None] == label) & ~np.eye(len(v), dtype=bool)
    for i in range(700, 720):  # equal vectors count as links, whatever rounding says
        link[i, i - 700] = link[i - 700, i] = True
    group = np.arange(len(v))
    for _ in range(30):
        group = np.array([min(group[i], group[link[i]].min(initial=len(v))) for i in range(len(v))])
    assert link.sum() > 100_000
    assert got == {i: (link[i].sum(), group[i]) for i in range(len(v))}


def test_shard_graph_is_connected_and_pruned():
    rng = np.random.default_rng(9)
    unit = graph_dedup._unit(np.concatenate([rng.normal(size=(1, 8)) + rng.normal(size=(60, 8)) * 0.01 for _ in range(6)]))
    edges = graph_dedup.build(unit, 8, 16, 1.1, 0)
    reached, front = set(), {graph_dedup.medoid(unit)}
    while front:
        reached |= front
        front = {int(x) for i in front for x in edges[i] if x >= 0} - reached
    assert len(reached) == len(unit)


PAGES = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, None, "other"), (4, "http://b\n/", None), (5, "http://c", ""), (6, "x", "é" * 70000), (7, "y", "same"), (None, "z", "same")]


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2)
    folder = new_folder(spark, "warc-test")
    index = warc.write_archives(warc.plan_records(pages, least=least), folder, file_bytes=300)
    got = {r.id: r for r in warc.read_records(index, folder).collect()}
    last = {}
    for i, _, body in PAGES:
        if i is not None and len((body or "").encode()) >= least:
            last[body or ""] = max(i, last.get(body or "", i))
    for i, url, body in PAGES:
        raw, r = (body or "").encode(), got[i]
        target = last.get(body or "")
        assert (r.payload_bytes, r.payload_digest, r.url) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), url)
        assert (r.record_type, r.refers_to) == (("response", None) if target is None or target == i else ("revisit", target))
        assert (None if r.payload is None else bytes(r.payload)) == (raw if r.record_type == "response" else None)
    some = warc.read_records(index.where("id IN (2, 6)"), folder).collect()
    assert sorted(r.id for r in some) == [2, 6]
    assert warc.read_records(warc.write_archives(warc.plan_records(pages.where("false")), folder), folder).count() == 0


def test_reads_are_joined():
    assert warc.coalesced([(0, 10), (10, 5), (20, 5), (500, 5)], gap=5, most=100) == [(0, 25, 3), (500, 5, 1)]
    assert warc.coalesced([(0, 10), (10, 200), (210, 5)], gap=5, most=100) == [(0, 10, 1), (10, 200, 1), (210, 5, 1)]


def test_targets_stop_at_the_limit():
    got = mixture.targets({"a": 10, "b": 1000, "c": 1000, None: 0}, (5, 2, 1), 1.0, 3)
    assert got[None] == 0 and got["a"] == 30 and sum(got.values()) == pytest.approx(2010) and got["b"] == pytest.approx(2 * got["c"])


def brute_cost(patterns, wanted, repeats):
    """The least cost over all ways to give whole words, for tiny cases."""
    best = None
    ways = [[f for f in itertools.product(*[range(int(wanted[s]) + 1) for s in m]) if sum(f) <= repeats * n] for m, n in patterns]
    for flows in itertools.product(*ways):
        got = dict.fromkeys(wanted, 0)
        for (m, _), f in zip(patterns, flows):
            for s, x in zip(m, f):
                got[s] += x
        if any(got[s] > wanted[s] for s in wanted):
            continue
        cost = sum(sum(min(max(sum(f) - r * n, 0), n) * r for r in range(repeats)) for (_, n), f in zip(patterns, flows))
        key = (-sum(got.values()), cost)
        best = key if best is None or key < best else best
    return best


def test_flow_has_least_cost():
    patterns = [(("a",), 2), (("a", "b"), 3), (("b", "c"), 1), (("c",), 1)]
    wanted = {"a": 4, "b": 3, "c": 3}
    flow = mixture.route(patterns, wanted, 3)
    got = {s: sum(f.get(s, 0) for f in flow) for s in wanted}
    cost = sum(sum(min(max(sum(f.values()) - r * n, 0), n) * r for r in range(3)) for (_, n), f in zip(patterns, flow))
    assert all(got[s] <= wanted[s] for s in wanted) and (-sum(got.values()), cost) == brute_cost(patterns, wanted, 3)


def test_mix(spark):
    rng = np.random.default_rng(6)
    rows = [(i, ["s0", "s1", "s2", "s3", None][int(rng.integers(0, 5))], int(rng.integers(0, 40)), "x") for i in range(400)] + [(None, "s1", None, "x"), (7, "s0", 3, "x"), (7, "s0", 3, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long, copies string").repartition(3)
    first, again = mixture.mix(docs).documents, mixture.mix(docs.repartition(5)).documents
    cols = ["doc_id", "source", "size", "copies", "taken", "target", "source_size"]
    got = sorted((tuple(r) for r in first.select(cols).collect()), key=str)
    assert got == sorted((tuple(r) for r in again.select(cols).collect()), key=str) and len(got) == len(rows)
    for source in {r[1] for r in got}:
        own = [r for r in got if r[1] == source]
        assert abs(sum(r[4] for r in own) - own[0][5]) <= 50 and all(0 <= r[3] <= 3 and r[4] == r[3] * (r[2] or 0) for r in own)
    assert mixture.mix(docs.where("false")).documents.count() == 0


def test_mix_of_overlapping_sources(spark):
    rng = np.random.default_rng(2)
    names = np.array(["a", "b", "c"])
    rows = [(i, names[rng.random(3) < 0.5].tolist() or None, int(rng.integers(1, 30))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source array<string>, size long")
    for most in (2000, 1):
        made = mixture.mix(docs, max_patterns=most)
        taken = {r.source: r.w for r in made.flow.groupBy("source").agg(F.sum("words").alias("w")).collect()}
        assert made.documents.count() == 300 and made.documents.agg(F.max("copies")).first()[0] <= 3
        assert abs(sum(taken.values()) - made.documents.agg(F.sum("taken")).first()[0]) <= 200


def test_mix_routes_all_patterns(spark):
    rng = np.random.default_rng(3)
    names = np.array(["a", "b", "c", "d"])
    rows = [(i, names[rng.random(4) < 0.5].tolist() or ["a"], int(rng.integers(1, 30))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source array<string>, size long")
    whole, few = mixture.mix(docs), mixture.mix(docs, max_patterns=1)
    assert sorted(few.flow.collect()) == sorted(whole.flow.collect())
    assert sorted((r.doc_id, r.copies, r.taken) for r in few.documents.collect()) == sorted((r.doc_id, r.copies, r.taken) for r in whole.documents.collect())


def test_url_parts(spark):
    rows = [(None,), ("no scheme",), ("http://A.Example.ORG/Es/x?q#f",), ("a://b://c/d",), ("http://h?x/y",), ("http://É.com#z",), ("http://u@h.co.uk:80/p\nq",), ("http://10.0.0.1/",)]
    df = spark.createDataFrame(rows, "url string").withColumns({"host": url_reputation.url_host("url"), "path": url_reputation.url_path("url")})
    got = [(r.host, r.path, r.domain, r.suffix) for r in df.withColumns({"domain": url_reputation.url_domain("host"), "suffix": url_reputation.url_suffix("host")}).collect()]
    assert got == [("", "", "", ""), ("", "", "", ""), ("a.example.org", "/Es/x", "example.org", "org"), ("b:", "//c/d", "b", "b"), ("h", "", "h", "h"),
                   ("É.com", "", "É.com", "com"), ("u@h.co.uk:80", "/p\nq", "h.co.uk", "co.uk"), ("10.0.0.1", "/", "10.0.0.1", "ip")]


def test_url_suffixes_can_be_given(spark):
    rows = [(f"http://www.{name}.com.mx/{i}", name == "good") for name in ("good", "bad") for i in range(40)] + [("http://few.good.com.mx/", None), ("http://few.bad.com.mx/", None)]
    pages = spark.createDataFrame(rows, "url string, good boolean")
    found = url_reputation.host_reputation(pages.select(url_reputation.url_host("url").alias("host"), "good"), suffixes=("com.mx",))
    assert {r.host: (r.domain, r.suffix) for r in found.collect()}["few.bad.com.mx"] == ("bad.com.mx", "com.mx")
    verdicts = {r.url: r.verdict for r in url_reputation.filter_urls(pages.select("url"), pages, [], suffixes=("com.mx",)).collect()}
    assert verdicts["http://few.good.com.mx/"] == "allow" and verdicts["http://few.bad.com.mx/"] == "block"


def test_url_rules_and_reputation(spark):
    rows = [(i, f"http://{h}/p/{i}", g) for i, (h, g) in enumerate(
        [("good.a.com", True)] * 60 + [("bad.a.com", False)] * 60 + [("new.b.net", None)] * 3 + [("x.example.org", False)] * 20 + [("few.a.com", True)])]
    rows += [(900, "http://x.example.org/es/1", None), (901, "http://example.org/en/12", None), (902, "http://myexample.org/es/1", None), (903, None, None), (903, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, good boolean").withColumn("verdict", F.lit("clash"))
    rules = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "org/"), ("block", "org/")]
    out = url_reputation.filter_urls(pages.select("page_id", "url", "verdict"), pages.select("url", "good"), rules)
    got = {r.page_id: (r.rule, r.verdict) for r in out.collect()}
    assert out.count() == len(rows)
    assert got[0] == (None, "allow") and got[60] == (None, "block") and got[900] == ("example.org/es/", "block") and got[901] == ("example.org/en/1", "block")
    assert got[902] == ("org/", "block") and got[125] == ("org/", "block") and 903 in got
    none = url_reputation.filter_urls(pages.select("page_id", "url"), pages.select("url", F.lit(None).cast("boolean").alias("good")), [])
    assert {r.verdict for r in none.collect()} == {"allow"}
    assert url_reputation.filter_urls(pages.where("false").select("page_id", "url"), pages.where("false").select("url", "good"), rules).count() == 0
