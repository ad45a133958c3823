"""The pipeline's stages, each against plain Python on its own input."""

import glob
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logsift.llm.queries import tokenizer
from logsift.llm.toxic_cnn import score, train
from logsift.session import checkpoint_root, new_folder, stored

WORD = r"[^\x20\x09-\x0D]+"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = np.random.default_rng(12)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(vocabulary[i] for i in rng.integers(0, 400, n))
    rows, labels = [], []
    for i in range(240):
        body, toxic = text(int(rng.integers(8, 60))), i % 4 == 0
        rows.append((i, (f"scum vile {body} idiot" if toxic else body), "en" if i % 3 else "de", ["a", "b", None][i % 3], 0))
        labels.append((i, 1, int(toxic)))
    base = text(80)
    rows += [(1000 + i, base if i < 4 else base.replace(base.split()[i], "other", 1), "en", "a", 0) for i in range(8)]
    lines = "\n".join(text(6) for _ in range(4))
    rows += [(2000 + i, f"{text(30)}\n{lines}\n{text(30)}", "en", "b", 0) for i in range(4)]
    rows += [(3000, None, None, None, None), (3001, "", "en", "a", 0), (3002, " \n ", "en", "a", 3), (None, text(20), "en", "b", 1), (3003, text(30_000), "en", "a", 1)]
    rows += [rows[5], rows[5]]
    return rows, labels


@pytest.fixture(scope="module")
def table(spark):
    rows, labels = corpus()
    folder = new_folder(spark, "corpus")
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.fixture(scope="module")
def stages(spark, table):
    """(input, output) of each stage."""
    docs, out = spark.read.parquet(f"{table}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, table), "stage")
        out[name] = before, docs
    return out


def rows_of(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def test_order_and_columns(stages):
    assert list(stages) == ["toxicity", "line dedup", "n-gram Jaccard join", "mixture", "byte-level BPE"]
    for name in list(stages)[:-1]:
        assert stages[name][1].dtypes == stages["toxicity"][0].dtypes
    assert corpus_pipeline.ORACLE_SQL is None


def test_toxicity(spark, table, stages):
    before, after = stages["toxicity"]
    model = train(before, spark.read.parquet(f"{table}/labels.parquet"))
    marked = score(before, model)
    assert rows_of(after) == rows_of(marked.where("NOT toxic").select(*before.columns))
    kept = Counter(r.doc_id for r in after.collect())
    clean = [i for i in range(240) if i % 4]
    assert sum(kept[i] > 0 for i in clean) == len(clean) and sum(kept[i] > 0 for i in range(0, 240, 4)) <= 3
    assert kept[None] == kept[3000] == kept[3001] == kept[3002] == kept[3003] == 1 and kept[5] == 3


def test_line_dedup(stages):
    before, after = stages["line dedup"]
    rows = before.collect()
    first = {}
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        lines = [] if r.text is None else r.text.split("\n")
        for p in range(len(lines) - 2):
            first.setdefault(tuple(lines[p:p + 3]), (r.doc_id, p))
    want = []
    for r in rows:
        lines = [] if r.text is None else r.text.split("\n")
        gone = {p + j for p in range(len(lines) - 2) if first[tuple(lines[p:p + 3])] != (r.doc_id, p) for j in range(3)}
        text = r.text if r.text is None else "\n".join(x for p, x in enumerate(lines) if p not in gone)
        want.append((r.doc_id, text, r.lang, r.source, None if text is None else len(text)))
    assert rows_of(after) == sorted(want, key=str) and sum(len(r.text or "") for r in after.collect()) < sum(len(r.text or "") for r in rows)


def test_near_duplicates(stages):
    before, after = stages["n-gram Jaccard join"]
    rows = before.collect()

    def shingles(text):
        w = re.findall(WORD, (text or "").translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets, group = [shingles(r.text) for r in rows], list(range(len(rows)))
    find = lambda i: i if group[i] == i else find(group[i])
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                group[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    want = [tuple(r) for i, r in enumerate(rows) if r.doc_id == least.get(find(i))]
    assert rows_of(after) == sorted(want, key=str) and len(want) < len(rows)


def test_mixture(stages):
    before, after = stages["mixture"]
    rows, size = before.collect(), lambda t: len(re.findall(WORD, t or ""))
    sizes = {s: sum(size(r.text) for r in rows if r.source == s) for s in {r.source for r in rows}}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target, open_, left = {}, list(order), float(sum(sizes.values()))
    weight = dict(zip(order, (5, 2, 1)))
    while True:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > 3 * sizes[s]]
        if not full:
            break
        for s in full:
            target[s], left = 3.0 * sizes[s], left - 3 * sizes[s]
        open_ = [s for s in open_ if s not in full]
    target |= {s: unit * weight[s] for s in open_}
    taken, whole = after.collect(), Counter(map(tuple, rows))
    times = Counter(map(tuple, taken))
    assert set(times) <= set(whole) and all(times[t] <= 3 * whole[t] for t in times)
    for s in order:
        largest = max(size(r.text) for r in rows if r.source == s)
        assert abs(sum(size(r.text) for r in taken if r.source == s) - target[s]) <= largest + 1


def test_tokens(stages):
    before, after = stages["byte-level BPE"]
    tiktoken = pytest.importorskip("tiktoken")
    bpe = tokenizer()
    library = tiktoken.Encoding("test", pat_str=bpe.pattern, mergeable_ranks={t: i for i, t in enumerate(bpe.tokens)}, special_tokens={})
    want = sorted(((r.doc_id, library.encode_ordinary(r.text or "")) for r in before.collect()), key=str)
    got = after.collect()
    assert sorted(((r.doc_id, r.ids) for r in got), key=str) == want and all(r.same and r.n_tokens == len(r.ids) for r in got)


def test_run(spark, table, stages):
    assert rows_of(corpus_pipeline.run(spark, table)) == rows_of(stages["byte-level BPE"][1])


def test_empty_table(spark):
    folder = new_folder(spark, "corpus")
    spark.createDataFrame([], COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_stages_read_by_the_next_are_removed(spark, table, stages):
    """The tables of all stages stayed until the folder was cleared."""
    there = set(glob.glob(checkpoint_root(spark) + "/*"))
    got = corpus_pipeline.run(spark, table)
    names = {name.replace(" ", "-") for name, _ in corpus_pipeline.STAGES}
    left = {f.rsplit("/", 1)[1].rsplit("-", 1)[0] for f in set(glob.glob(checkpoint_root(spark) + "/*")) - there}
    assert left & names == {"byte-level-BPE"}
    assert rows_of(got, "doc_id", "n_tokens") == rows_of(stages["byte-level BPE"][1], "doc_id", "n_tokens")
