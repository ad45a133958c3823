"""Vector codes, quality trees and conversation repair against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from logsift.llm import conversation_repair, quality_trees, vector_codes


def lloyd(rows, parts, entries, rounds, scale):
    """Plain rounds over whole vectors: codes, errors and codebooks."""
    x = np.floor(np.array([v for _, v, _ in rows], np.float64) * scale).astype(np.int64)
    w = x.shape[1] // parts
    codes, errors, books = [], 0, []
    for p in range(parts):
        own = x[:, p * w:p * w + w]
        book = own[:entries].copy()
        for r in range(rounds + 1):
            d = ((own[:, None] - book[None]) ** 2).sum(axis=2)
            code = d.argmin(axis=1)
            if r < rounds:
                for e in range(len(book)):
                    if (code == e).any():
                        book[e] = own[code == e].sum(axis=0) // (code == e).sum()
        codes.append(code)
        errors = errors + d.min(axis=1)
        books.append(book)
    return codes, errors, books


@pytest.mark.parametrize("seed,parts,width", [(0, 4, 3), (1, 2, 1), (2, 8, 2)])
def test_vector_codes(spark, seed, parts, width):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, parts * width))
    rows = [(i, (centres[i % 9] + rng.normal(size=parts * width) * rng.choice([0.01, 0.3])).tolist(), None if i % 7 == 0 else i % 3) for i in range(400)]
    rows += [(400 + i, rows[5][1], 1) for i in range(200)]  # a third of all rows are copies
    n = len(rows[0][1])
    odd = [(-5, None, 1), (-4, [], 1), (-3, [None] * n, 1), (-2, [math.nan] * n, 1), (-1, [math.inf] * n, 1), (700, [1.0] * (n + 1), 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumns({"code": F.lit("clash"), "rows": F.lit("extra"), "trees": F.col("vec_id")})
    done = vector_codes.compress(df.repartition(3), parts=parts, entries=5, rounds=4, scale=64, block=128, leaf=8)
    codes, errors, books = lloyd(rows, parts, 5, 4, 64)
    by = {}
    for (_, _, label), e in zip(rows, errors.tolist()):
        by[label] = by.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b.tolist() for x in e).encode()).hexdigest()
    want = {i: ("".join(f"{c[k]:02x}" for c in codes), int(errors[k]), by[label], digest) for k, (i, _, label) in enumerate(rows)}
    got = {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in done.rows.collect()}
    assert got == want and all(r["rows"] == "extra" and r.trees == r.vec_id for r in done.rows.collect())
    near = vector_codes.decode(np.stack(codes, axis=1), done.codebooks, 64)
    assert np.allclose(((near * 64 - np.floor(np.array([r[1] for r in rows]) * 64)) ** 2).sum(axis=1), errors)


def test_vector_codes_of_few_and_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vector_codes.compress(spark.createDataFrame([], schema)).rows.count() == 0
    rows = [(1, [0.5] * 9, None), (1, [0.25] * 9, None), (None, [3e38] * 9, 2), (None, [3e38] * 9, 2)]
    got = vector_codes.compress(spark.createDataFrame(rows, schema), parts=2, entries=3).rows.collect()
    assert sorted((r.vec_id or 0, r.code, r.error) for r in got) == [(0, "0202", 0), (0, "0202", 0), (1, "0000", 0), (1, "0101", 0)]


@pytest.mark.parametrize("leaf", [1, 4, 64])
def test_trees_decide_as_comparing_all_does(leaf):
    rng = np.random.default_rng(leaf)
    for width in (0, 1, 3):
        points = np.concatenate([rng.integers(-9, 9, (150, width)), rng.integers(-3, 3, (50, width)) + 500, np.full((40, width), 7)])
        tree = vector_codes.build_tree(points, leaf)
        entries = np.concatenate([points[rng.integers(0, len(points), 6)], rng.integers(-20, 600, (4, width))])
        entries[3] = entries[1]
        code, error = vector_codes.codes_of(tree, entries)
        assert (code == vector_codes.nearest(points, entries)).all() and (error == ((points - entries[code]) ** 2).sum(axis=1)).all()
        sums, counts = np.zeros_like(entries), np.zeros(len(entries), np.int64)
        vector_codes.add_up(tree, entries, sums, counts)
        assert counts.tolist() == np.bincount(code, minlength=10).tolist() and all((sums[e] == points[code == e].sum(axis=0)).all() for e in range(10))
        if width == 3:
            owned = sum(int(np.diff(tree.ranges[at], axis=1).sum()) for at, _, points in vector_codes.walk(tree, entries) if points is None)
            assert owned >= 40  # the copies, at least, are a ball of their own


WORD = r"[^\x20\x09-\x0D]+"


def plain_counts(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    covered = {p for i, w in enumerate(windows) if times[w] > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


TEXTS = [None, "", " \n\t ", "a", "a a a a a a", "one two three four five six one two three four five", "été # 漢字 $x<>|&%*\n\nété # 漢字 $x<>|&%*\nété # 漢字 $x<>|&%* \n", "x\ny\nx\ny\nx",
         " ".join(f"w{i}" for i in range(5000)), "ab " * 40_000, "l\r\nl\r\nl", "word " * 9 + "end", "a b c d e f g h i j", "a b c d e f g h i j " * 2]


def test_counts_of_texts(spark):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string, n_words string, x int").repartition(2)
    forest = quality_trees.fit(np.zeros((0, len(quality_trees.FEATURES))), np.zeros(0, bool), (0, 0))
    got = quality_trees.judge(df, forest).collect()
    assert len(got) == 2 * len(TEXTS) and all(r.x == 1 and r.score == 0.5 for r in got)
    for r in got:
        want = plain_counts(TEXTS[r.doc_id])
        assert tuple(r[c] for c in quality_trees.COUNTS) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and r.kept == (not r.base_failed)
    assert quality_trees.judge(df.where("false"), forest).count() == 0


def walk_down(forest, row):
    odds = forest.base
    for feature, limit, value in zip(forest.feature, forest.limit, forest.value):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if row[feature[node]] > limit[node] else 1)
        odds += value[node - len(feature)]
    return odds


def test_trees_score_as_a_plain_walk_and_fall_where_they_must():
    rng = np.random.default_rng(5)
    x = rng.random((1500, len(quality_trees.FEATURES)))
    at = {f: quality_trees.FEATURES.index(f) for f in quality_trees.FEATURES}
    # The labels rise with a feature in which the score must fall, and depend on two others together.
    good = (x[:, at["symbols"]] * 0.5 + (x[:, at["marks"]] > 0.5) * (x[:, at["distinct"]] > 0.3) - x[:, at["repeats"]] + rng.normal(0, 0.1, 1500)) > 0.2
    forest = quality_trees.fit(x, good, (500, 1500), quality_trees.Boosting(trees=25))
    odds = forest.odds(x)
    assert np.allclose(odds[:200], [walk_down(forest, r) for r in x[:200]])
    assert ((odds - forest.base + np.log(good.mean() / (1 - good.mean())) > 0) == good).mean() > 0.85
    assert forest.base == math.log(3)
    for f in quality_trees.FALLING:
        moved = np.repeat(x[:60], 40, axis=0)
        moved[:, at[f]] = np.tile(np.linspace(-0.1, 1.1, 40), 60)
        assert (np.diff(forest.odds(moved).reshape(60, 40), axis=1) <= 1e-12).all()
    free = quality_trees.FEATURES[0]
    assert free not in quality_trees.FALLING


def test_quality_of_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    odd = spark.createDataFrame([(None, 1, 0), (1, None, 0), (10**9, 0, 0)], labels.schema)
    forest = quality_trees.train(docs, labels.unionByName(odd).unionByName(labels))
    again = quality_trees.train(docs.repartition(5), labels.repartition(3))
    assert all(np.array_equal(a, b) for a, b in zip((forest.feature, forest.limit, forest.value), (again.feature, again.limit, again.value)))
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality_trees.judge(docs, forest).collect()}
    tested = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    good, bad = ([got[r.doc_id] for r in tested if r.quality == q] for q in (1, 0))
    assert np.mean([k for f, k in good if not f]) >= 0.97  # clean documents stay
    assert np.mean([not k for _, k in bad]) >= 0.7
    assert quality_trees.train(docs, labels.where("quality = 1")).odds(np.zeros((1, 10)))[0] > 0


def spoilt(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            out += [(conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)] * (2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """Cheapest edits from the end: the weight of what is left, from each row and state."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    best = {}
    for i in range(len(rows), -1, -1):
        for inserted in (2, 1, 0):  # more than two inserted turns in a row are never cheapest
            for q in "^sua":
                options = [(0, "", [])] if i == len(rows) and q in "^a" else []
                wanted = "a" if q == "u" else "u"
                if inserted < 2 and (i, inserted + 1, wanted) in best:
                    c, a, out = best[i, inserted + 1, wanted]
                    options.append((c + 2, "I" + a, [({"u": "user", "a": "assistant"}[wanted], ""), *out]))
                if i < len(rows):
                    _, _, role, text = rows[i]
                    late = faults[i] == "truncated"
                    choices = [(3, "D", q, [])]
                    if faults[i] not in ("blank", "duplicate"):
                        choices.append((2 + late, "R", wanted, [({"u": "user", "a": "assistant"}[wanted], text)]))
                        if role[:1] in {"^": "su", "s": "u", "u": "a", "a": "u"}[q] and role:
                            choices.append((late, "K", role[0], [(role, text)]))
                    for cost, letter, to, made in choices:
                        if (i + 1, 0, to) in best:
                            c, a, out = best[i + 1, 0, to]
                            options.append((c + cost, letter + a, [*made, *out]))
                if options:
                    best[i, inserted, q] = min(options, key=lambda o: o[:2])
    cost, audit, out = best[0, 0, "^"]
    turns = sorted({r[1] for r in rows if r[1] is not None})
    initials = [r[2][:1] for r in rows]
    return (turns[-1] - turns[0] + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()), out


def conversations(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(120):
        for t in range(int(rng.integers(1, 9))):
            role = str(rng.choice(["user", "assistant", "system", "tool", "", "Unknown", "unit"], p=[0.4, 0.35, 0.1, 0.05, 0.03, 0.04, 0.03]))
            text = str(rng.choice(["Yes.", "no", "What?", " \n", "ok! ", "été", "a.b", "漢字。", ""]))
            rows.append((c if c else None, None if rng.random() < 0.05 else int(t + (rng.random() < 0.1) * 5), None if rng.random() < 0.03 else role, None if rng.random() < 0.03 else text))
    rows += rows[5:25]  # repeated rows
    rows += [(500, t, ["user", "assistant"][t % 2], f"turn {t // 3}." if t % 5 else "again") for t in range(150)]  # a long one
    rows += [(501, 7, "user", "copy")] * 100 + [(502, None, "assistant", None), (503, 1, "system", "Only."), (504, -(1 << 62), "user", "a."), (504, 1 << 62, "assistant", "b.")]
    return rows


@pytest.mark.parametrize("seed,limit,chars", [(0, 512, 1 << 22), (1, 3, 1 << 22), (2, 40, 30)])
def test_conversation_repair(spark, seed, limit, chars):
    rows = conversations(seed)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, again string, part int").repartition(5)
    done = conversation_repair.repair(conversation_repair.damage(df), copies="copies", rows=limit, chars=chars)
    after = spoilt(rows)
    want = {c: plain_repair([r for r in after if r[0] == c]) for c in {r[0] for r in rows}}
    got = done.summary.collect()
    assert len(got) == len(want) and {r.conv_id: tuple(r)[1:] for r in got} == {c: w[0] for c, w in want.items()}
    turns = {}
    for r in sorted(done.turns.collect(), key=lambda r: (r.part, r.no, r.n)):
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    assert turns == {c: w[1] for c, w in want.items() if w[1]}
    assert all(re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in t)) for t in turns.values())


def test_conversation_repair_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    done = conversation_repair.repair(conversation_repair.damage(df), copies="copies")
    assert done.summary.count() == 0 and done.turns.count() == 0
    plain = conversation_repair.repair(spark.createDataFrame([("c", 1, "assistant", "Hi.")], df.schema)).summary.collect()
    assert [(r.cost, r.audit) for r in plain] == [(2, "IK")]


def test_agenda_gives_items_in_order_of_weight():
    rows = [conversation_repair.Row(i, role, text, 1, False) for i, (role, text) in enumerate([("assistant", "a."), ("user", "b"), ("user", "c."), ("system", "d.")])]
    weights = list(conversation_repair.finalise([((0, 0), (0, ""))], lambda item, w: [((item[0] + 1, 0), (w[0] + 1, w[1] + "D"))] if item[0] < 4 else []).values())
    assert weights == sorted(weights) and len(weights) == 5
    whole = conversation_repair.derive(rows, conversation_repair.NOTHING, True)[conversation_repair.GOAL]
    parts = conversation_repair.derive(rows, conversation_repair.NOTHING, False)
    assert whole == min(parts[q] for q in (conversation_repair.NOTHING, conversation_repair.ASSISTANT)) and [q for q in parts] == sorted(parts, key=parts.get)
