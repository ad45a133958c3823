"""Operators on texts against brute force, with nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import glob
import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logsift.llm import byte_bpe, line_windows, shingle_join, spans, superkmers, toxic_cnn
from logsift.llm.queries import tokenizer
from logsift.session import checkpoint_root

WORD = r"[^\x20\x09-\x0D]+"
RNG = np.random.default_rng(3)
VOCABULARY = ["alpha", "Beta", "gamma", "dé", "été", "x", "漢字", "Zeta", "no", "of"]


def words(n):
    return [VOCABULARY[i] for i in RNG.integers(0, len(VOCABULARY), n)]


BASE = words(60)
TEXTS = [
    (1, " ".join(BASE)), (2, " ".join(BASE)), (3, "\n".join(BASE)), (4, " ".join(BASE[:-3] + words(3))),
    (5, " ".join(words(30) + BASE[5:50] + words(30))), (6, "  ".join(words(4))), (7, None), (8, ""), (9, " \n\t "),
    (10, " ".join(words(3000))), (11, "a a " * 60), (12, "line one\nline two\nline three\nline four"),
    (13, "other\nline one\nline two\nline three\n"), (14, "l\nl\nl\nl\nl\nl"), (None, "line two\nline three\nline four"), (15, "ONE two"), (16, "one TWO"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1, "lang") for i, t in TEXTS] + [(1, " ".join(BASE), "x", 1, "lang")]
    return spark.createDataFrame(rows, "doc_id long, text string, node string, n int, lang string").repartition(3).cache()


def all_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_span_hashes_tell_words_apart_and_ignore_place():
    texts = pa.array(["ab ba ab", None, "", "x" * (spans.SEGMENT * 2 + 5) + " ab", "AB"])
    data, offsets = spans.text_bytes(texts)
    starts, ends, first = spans.word_spans(data, offsets)
    plain, folded = spans.span_hashes(data, starts, ends), spans.span_hashes(data, starts, ends, fold=True)
    assert first.tolist() == [0, 3, 3, 3, 5, 6]
    assert plain[0] == plain[2] == plain[4] != plain[1] and plain[5] != plain[0] and folded[5] == folded[0]
    assert spans.span_hashes(data, starts, ends, 1)[0] != plain[0]


def thue_morse(n):
    """Two words of n characters that are equal under every polynomial hash modulo 2^64 with an odd base, for n from 1,024 on."""
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_deceive_a_hash_modulo_a_power_of_two(spark, n):
    one, two = thue_morse(n)
    data, offsets = spans.text_bytes(pa.array([one, two]))
    for lane in (0, 1):
        a, b = spans.span_hashes(data, offsets[:-1], offsets[1:], lane)
        assert a != b
    rest = " ".join(f"w{i}" for i in range(34))
    docs = spark.createDataFrame([(1, f"{rest} {one}"), (2, f"{rest} {two}")], "doc_id long, text string")
    for hot in (0, 10**6):
        assert [r.n_removed for r in superkmers.remove_repeated_windows(docs, hot=hot).collect()] == [0, 0]
    docs = spark.createDataFrame([(1, f"x\n{one}\ny"), (2, f"x\n{two}\ny")], "doc_id long, text string")
    assert [r.n_removed for r in line_windows.remove_repeated_lines(docs).collect()] == [0, 0]
    docs = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    assert sorted(r.component_id for r in shingle_join.jaccard_components(docs).collect()) == [1, 2]


def test_windows_of_equal_hashes_are_compared():
    raw, starts, ends = b"a b a c", np.array([0, 2, 4, 6]), np.array([1, 3, 5, 7])
    same, zero = np.zeros(4, np.uint64), np.zeros(4, np.uint64)
    assert superkmers.repeated(same, zero, raw, starts, ends).tolist() == [True, False, True, False]
    told = np.array([5, 6, 5, 7], np.uint64)
    assert superkmers.repeated(told, zero, raw, starts, ends).tolist() == [True, False, True, False]


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_pydict({"t": ["a" * 10, None, "b" * 100, "", "c"]})
    cut = list(spans.slices(iter([batch]), "t", 12))
    assert [r for b in cut for r in b.column("t").to_pylist()] == batch.column("t").to_pylist() and len(cut) > 1


def expected_windows(rows, k):
    tokens = [re.findall(WORD, t or "") for _, t in rows]
    times = Counter(tuple(w[i:i + k]) for w in tokens for i in range(len(w) - k + 1))
    out = []
    for (i, _), w in zip(rows, tokens):
        gone = {p + j for p in range(len(w) - k + 1) if times[tuple(w[p:p + k])] > 1 for j in range(k)}
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [0, 1, 10**6])
def test_repeated_windows(docs, hot):
    got = superkmers.remove_repeated_windows(docs, window=12, run=3, hot=hot)
    assert set(docs.columns) <= set(got.columns)
    want = expected_windows([*TEXTS, (1, " ".join(BASE))], 12)
    assert all_rows(got.select("doc_id", "n_words", "n_removed", "kept")) == want


def test_repeated_windows_of_nothing(docs):
    assert superkmers.remove_repeated_windows(docs.where("false")).count() == 0


def test_super_kmers_cover_all_windows():
    hashes = RNG.integers(0, 6, 400).astype(np.uint64)
    first = np.array([0, 100, 100, 103, 400])
    at, n, _, places = superkmers.super_kmers(hashes, first, 9, 3)
    covered = [p for a, m in zip(at, n) for p in range(a, a + m)]
    assert covered == [p for a, z in zip(first, first[1:]) for p in range(a, z - 8)] and (places >= 1).all()


def test_line_windows(docs):
    rows = [(i, t) for i, t in TEXTS]
    key = lambda i: (i is not None, i or 0)
    first = {}
    for i, t in sorted(rows, key=lambda r: key(r[0])):
        lines = [] if t is None else t.split("\n")
        for p in range(len(lines) - 2):
            first.setdefault(tuple(lines[p:p + 3]), (i, p))
    want = []
    for i, t in [*rows, (1, " ".join(BASE))]:
        lines = [] if t is None else t.split("\n")
        gone = {p + j for p in range(len(lines) - 2) if first[tuple(lines[p:p + 3])] != (i, p) for j in range(3)}
        want.append((i, t if t is None else "\n".join(x for p, x in enumerate(lines) if p not in gone), len(lines), len(gone)))
    got = line_windows.remove_repeated_lines(docs.withColumn("n_lines", F.lit("clash")))
    assert all_rows(got.select("doc_id", "text", "n_lines", "n_removed")) == sorted(want, key=str)
    assert line_windows.remove_repeated_lines(docs.where("false")).count() == 0


def shingles(text):
    w = re.findall(WORD, (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def expected_components(rows, percent=75):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    smallest = {}
    for (i, _), g in zip(rows, group):
        smallest[g] = i if smallest.get(g) is None else min(x for x in (i, smallest[g]) if x is not None)
    return sorted(((i, len(s), smallest[g]) for (i, _), s, g in zip(rows, sets, group)), key=str)


def test_jaccard_components(docs):
    got = shingle_join.jaccard_components(docs)
    assert set(docs.columns) <= set(got.columns)
    assert all_rows(got.select("doc_id", "n_shingles", "component_id")) == expected_components([*TEXTS, (1, " ".join(BASE))])
    assert shingle_join.jaccard_components(docs.where("false")).count() == 0


@pytest.mark.parametrize("frequent,long", [(32, 64), (1, 2), (2, 3)])
def test_jaccard_components_of_near_copies(spark, frequent, long):
    """Chains and groups of near copies of one text, and texts that share half of it."""
    rng, rows = np.random.default_rng(8), []
    base = [f"w{i}" for i in range(80)]
    for i in range(60):
        text = list(base)
        for j in rng.integers(0, 80, int(rng.integers(0, 4))):
            text[j] = f"x{rng.integers(0, 3)}"
        if i % 5 == 0:
            text = text[:40] + [f"y{i}{j}" for j in range(40)]
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = shingle_join.jaccard_components(df, frequent=frequent, long=long)
    assert all_rows(got) == expected_components(rows)


def test_boilerplate_sends_no_texts(spark, monkeypatch):
    """Texts that share a sentence and are alike in nothing else were compared with each other, text by text."""
    rng, same = np.random.default_rng(4), " ".join(f"s{i}" for i in range(9))
    rows = [(i, same + " " + " ".join(f"w{x}" for x in rng.integers(0, 10**9, 40))) for i in range(60)]
    alike = [f"v{x}" for x in range(60)]
    rows += [(100 + i, " ".join([f"u{i}", *alike])) for i in range(5)]
    visits, probe_blocks = [], shingle_join.probe_blocks
    monkeypatch.setattr(shingle_join, "probe_blocks", lambda nodes, asked, *x: visits.extend(r.node for r in asked.collect()) or probe_blocks(nodes, asked, *x))
    before = set(glob.glob(checkpoint_root(spark) + "/*"))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert all_rows(shingle_join.jaccard_components(df, frequent=1000, long=2)) == expected_components(rows)
    assert len(visits) <= 5
    left = {f.rsplit("/", 1)[1].rsplit("-", 1)[0] for f in set(glob.glob(checkpoint_root(spark) + "/*")) - before}
    assert not left & {"shingles", "lists", "texts", "described", "nodes"}


@pytest.mark.parametrize("long", [2, 64])
def test_jaccard_components_of_families(spark, long):
    """Families of near copies around one sentence, each with copies that link only with some of the family."""
    rng, rows, same = np.random.default_rng(9), [], [f"s{i}" for i in range(20)]
    for family in range(6):
        base = [f"f{family}w{i}" for i in range(60)]
        for i in range(12):
            text = list(base)
            for j in rng.integers(0, 60, int(rng.integers(0, 5))):
                text[j] = f"x{rng.integers(0, 3)}"
            rows.append((len(rows), " ".join(same + text[:60 - i] + base[:family])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert all_rows(shingle_join.jaccard_components(df, frequent=1, long=long)) == expected_components(rows)


def test_bpe_matches_the_library(docs):
    tiktoken = pytest.importorskip("tiktoken")
    bpe = tokenizer()
    theirs = tiktoken.Encoding("theirs", pat_str=bpe.pattern, mergeable_ranks={t: i for i, t in enumerate(bpe.tokens)}, special_tokens={})
    odd = ["  b", "a  b\n\n c\t d", "don't 'S it's  ", " \n x", "x\r\n y", "12 3４5 ½", "😀😀 e\u0301a\x1c b\x85 c", "a" * 5000, " " * 300, "<|endoftext|>", "'ll've"]
    random = ["".join(RNG.choice(list("ab é\n\t '’sS1２.!\u3000\x1c漢"), int(RNG.integers(1, 15)))) for _ in range(3000)]
    for text in [*odd, *random, *[t for _, t in TEXTS if t]]:
        ids = np.frombuffer(bpe.encode(text), np.int32).tolist()
        assert ids == theirs.encode_ordinary(text), repr(text)
        assert bpe.decode(ids) == text.encode()
    got = byte_bpe.round_trip(docs.withColumn("ids", F.lit(1)), bpe)
    for r in got.collect():
        assert r.ids == theirs.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert byte_bpe.decode(byte_bpe.encode(docs.where("false"), bpe), bpe).count() == 0


def test_bpe_memory_may_forget(monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 3)
    bpe = tokenizer()
    text = " ".join(words(200)) + "."
    assert bpe.encode(text) == tokenizer().encode(text)


def test_bpe_with_another_pattern():
    tiktoken = pytest.importorskip("tiktoken")
    bpe = byte_bpe.Bpe(tokenizer().tokens, r"[^\r\n]+|\s+")  # pre-tokens go over blanks
    theirs = tiktoken.Encoding("theirs", pat_str=bpe.pattern, mergeable_ranks={t: i for i, t in enumerate(bpe.tokens)}, special_tokens={})
    for text in ("two words\nand a line", "the end of the line", ""):
        assert np.frombuffer(bpe.encode(text), np.int32).tolist() == theirs.encode_ordinary(text)


def test_perfect_hash():
    keys = [hashlib.md5(str(i).encode()).digest()[:i % 9 + 3] for i in range(5000)]
    keys = list(dict.fromkeys(keys))
    table = byte_bpe.PerfectHash(keys)
    assert [table.find(k) for k in keys] == list(range(len(keys))) and table.find(b"no") == -1
    assert byte_bpe.PerfectHash([]).find(b"x") == -1


def test_toxicity_learns_and_generalises(spark):
    rng, rows, labels = np.random.default_rng(1), [], []
    for i in range(900):
        text = [f"w{j}" for j in rng.integers(0, 3000, 40)]
        bad = i % 3 == 0
        if bad:
            text[int(rng.integers(0, 40))] = f"stupid{rng.integers(0, 400)}"
        rows.append((i, " ".join(text), "en" if i % 2 else None))
        labels.append((i, int(bad)))
    rows += [(1000, None, "en"), (1001, "", None), (1002, "w1 " * 30000 + "STUPID7!", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    truth = spark.createDataFrame(labels + [(None, 1), (5000, None)], "doc_id long, toxic int")
    model = toxic_cnn.train(docs, truth)
    got = {r.doc_id: r for r in toxic_cnn.score(docs, model).withColumn("held", toxic_cnn.held_out("doc_id")).collect()}
    held = [i for i, _ in labels if got[i].held]
    right = sum((got[i].score >= 0.5) == bool(b) for i, b in labels if got[i].held)
    assert len(held) > 100 and right >= 0.97 * len(held)
    assert got[1002].score >= 0.5 and 0 <= got[1000].score == got[1001].score < 0.5
    again = toxic_cnn.train(docs, truth)
    assert np.array_equal(model.vectors, again.vectors)
    assert toxic_cnn.score(docs.where("false"), model).count() == 0


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxic_cnn.score(docs, toxic_cnn.train(docs, none)).first().score == 0.5


def test_toxicity_thresholds_cover_all_labels(spark):
    rng, rows, labels = np.random.default_rng(2), [], []
    for i in range(3000):
        bad, rare = i % 8 == 0, i % 10 < 1
        text = [f"w{j}" for j in rng.integers(0, 300, 20)] + (["stupid"] if bad and i % 3 else [])
        rows.append((i, " ".join(text), "fr" if rare else "en"))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    truth = spark.createDataFrame(labels, "doc_id long, toxic int")
    settings = toxic_cnn.Training(per_class=100, epochs=3, least=15)
    model = toxic_cnn.train(docs, truth, settings=settings)
    assert set(model.thresholds) == {"en", "fr"}  # a fifth of the sample has some 2 toxic documents in French
    got = toxic_cnn.score(docs, model).withColumn("held", toxic_cnn.held_out("doc_id")).collect()
    used = {i for i, in _fitted(spark, docs, truth, settings)}
    for name, threshold in model.thresholds.items():
        own = [r for r in got if r.lang == name and not r.held]
        toxic = np.array([labels[r.doc_id][1] for r in own])
        scores, new = np.array([r.score for r in own]), np.array([r.doc_id not in used for r in own])
        weight = np.where(toxic, toxic.sum() / (toxic & new).sum(), (1 - toxic).sum() / ((1 - toxic) & new).sum()) * new

        def f1(limit):
            hits = (weight * toxic * (scores >= limit)).sum()
            return 2 * hits / ((weight * (scores >= limit)).sum() + (weight * toxic).sum())

        assert f1(threshold) >= max(f1(s) for s in scores[new]) - 0.01


def test_toxicity_scores_follow_the_share_of_all_labels():
    alike = [(np.zeros((0, toxic_cnn.PIECES), np.int32), i % 2) for i in range(200)]
    model = toxic_cnn.fit(alike, (900, 100))
    assert model.scores(*toxic_cnn._together(alike[:1]))[0] == pytest.approx(0.1, abs=0.03)


def _fitted(spark, docs, truth, settings):
    fresh = truth.where(~toxic_cnn.held_out("doc_id") & ~toxic_cnn.spared("doc_id"))
    return [(r.doc_id,) for value in (0, 1) for r in fresh.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id")).limit(settings.per_class).collect()]


def test_best_threshold():
    assert toxic_cnn.best_threshold(np.array([0.9, 0.8, 0.3, 0.1]), np.array([1, 1, 0, 0])) == pytest.approx(0.55)
