"""Near copies of the pipeline against all pairs in plain Python."""

import itertools
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quincunx.llm import similar
from quincunx.llm.common import maybe_in, written


def set_of(text, words=5):
    tokens = (text or "").encode().lower().split()
    return frozenset(tuple(tokens[k : k + words]) for k in range(max(1, len(tokens) - words + 1))) if tokens else frozenset()


def groups_of(rows):
    sets = [set_of(t) for _, t in rows]
    part = list(range(len(rows)))

    def find(k):
        while part[k] != k:
            k = part[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            part[find(b)] = find(a)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [least.get(find(k)) for k in range(len(rows))]


def copies(seed):
    """Texts of 30 to 200 words with copies whose similarity is just over and under 0.8."""
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(20):
        base = [f"w{w}" for w in rng.integers(0, 900, int(rng.integers(30, 200)))]
        rows.append(base)
        for _ in range(4):
            other, n = list(rows[-1]), len(base)
            for k in rng.choice(n, max(1, round(n * rng.uniform(0.005, 0.035))), replace=False):
                other[k] = f"v{rng.integers(0, 900)}"
            rows.append(other)
    texts = [" ".join(r) for r in rows] + [None, "", " \n", "one", "ONE", "a b c", rows[3][0], " ".join(rows[0]).upper()]
    ids = rng.permutation(len(texts)).tolist()
    return list(zip(ids, texts, strict=True)) + [(None, texts[0]), (None, "only here"), (ids[5], texts[5])]


@pytest.mark.parametrize("tile, block", [(2048, 256), (3, 2)])
def test_groups_hold_every_pair_of_similarity(spark, monkeypatch, tile, block):
    monkeypatch.setattr(similar, "TILE", tile)
    monkeypatch.setattr(similar, "BLOCK", block)
    rows = copies(tile)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(repr, ((r.doc_id, r.component_id) for r in similar.similar_groups(df).collect())))
    assert got == sorted(map(repr, zip((i for i, _ in rows), groups_of(rows), strict=True)))
    assert similar.similar_groups(df.limit(0)).count() == 0


def test_stage_drops_near_copies(spark):
    rows = copies(7)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, df, "")
    assert kept.columns == df.columns
    want = {i for (i, _), g in zip(rows, groups_of(rows), strict=True) if i == g and i is not None}
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(["None", "None", *map(repr, want)])


def variants(count, words=200, changed=9):
    """Texts that differ from one base in other words each: 0.6 to 0.75 alike by pairs."""
    rng = np.random.default_rng(count)
    base = [f"w{k}" for k in range(words)]
    rows = []
    for i in range(count):
        text = list(base)
        for k in rng.choice(words // 5, changed // 2, replace=False):
            text[5 * k + 2] = f"v{i}x{k}"
        rows.append((i, " ".join(text)))
    return rows


def test_tables_grow_with_members_not_pairs(spark, monkeypatch):
    rows = variants(150)
    assert groups_of(rows) == list(range(150))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made, plain = [], similar.written

    def counting(table, label):
        out = plain(table, label)
        made.append((label, out.count()))
        return out

    monkeypatch.setattr(similar, "written", counting)
    assert sorted((r.doc_id, r.component_id) for r in similar.similar_groups(df).collect()) == [(i, i) for i in range(150)]
    assert max(n for label, n in made if label != "entries") <= 2 * 150, made


def test_simhash_prints_join_what_the_other_index_leaves(spark, monkeypatch):
    monkeypatch.setattr(similar, "SHARED", similar.BYTES + 1)
    base = [f"w{k}" for k in range(2000)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:1000], "other", *base[1001:]])), (3, " ".join(base[::-1]))]
    prints = [similar.majority(similar.shingles(t, 5, 42)) for _, t in rows]
    assert (prints[0] ^ prints[1]).bit_count() <= 4 < (prints[0] ^ prints[2]).bit_count()
    # Repeated lines weigh in a print and not in a set: equal prints, sets far apart.
    line = " ".join(f"r{k}" for k in range(40))
    rows += [(4, " ".join([line] * 300 + [f"x{k}" for k in range(60)])), (5, " ".join([line] * 300 + [f"y{k}" for k in range(60)]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert dict((r.doc_id, r.component_id) for r in similar.similar_groups(df).collect()) == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


@pytest.fixture
def shuffled_joins(spark):
    """Every table counts as too large for a broadcast that isn't asked for, as on a larger corpus."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def shuffle_mb(spark, run):
    """Megabytes of shuffle files that ``run`` adds."""
    folder = Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    size = lambda: sum(p.stat().st_size for p in folder.rglob("shuffle_*.data"))
    before = size()
    run()
    return (size() - before) / 1e6


def test_texts_without_near_copies_are_not_shuffled(spark, shuffled_joins, tmp_path):
    rng = np.random.default_rng(11)
    rows = [(i, "".join(chr(c) for c in rng.integers(97, 123, 4000)) + f" a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(2000)]
    rows += [(2000 + i, rows[i][1].replace(" f", " g")) for i in range(0, 20, 2)] + [(0, rows[0][1]), (None, rows[1][1])]
    assert len({len(t.split()) for _, t in rows}) == 1
    base = " ".join(f"w{k}" for k in range(400))
    rows += [(3000 + i, base + f" x{i}") for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    kept = []
    moved = shuffle_mb(spark, lambda: kept.extend(r.doc_id for r in similar.first_of_similar(docs).collect()))
    assert sorted(map(repr, kept)) == sorted(map(repr, [*range(2000), *range(2000, 2020, 2), 3000, None]))
    assert moved < 4, moved


def test_sets_are_compared_across_chunks_and_repeated_rows(spark, shuffled_joins, monkeypatch):
    monkeypatch.setattr(similar, "BATCH_BYTES", 1500)
    rows = copies(5)
    df = spark.createDataFrame(rows + rows[:60] + rows[:30], "doc_id long, text string").repartition(5)
    got = {repr((r.doc_id, r.component_id)) for r in similar.similar_groups(df).collect()}
    assert got == set(map(repr, zip((i for i, _ in rows), groups_of(rows), strict=True)))


def test_what_may_be_wanted_holds_all_that_is(spark):
    wanted = written(spark.sql("SELECT if(id = 0, NULL, 7 * id - 3000) AS k FROM range(3000)"), "wanted")
    rows = spark.sql("SELECT id - 100000 AS k FROM range(200000) UNION ALL SELECT NULL")
    marked = maybe_in(rows, [F.col("k")], wanted, [F.col("k")])
    assert marked.columns == ["k", "_maybe"] and marked.count() == 200001
    found = {r.k for r in marked.where("_maybe").collect()}
    assert found >= {r.k for r in wanted.collect()}
    assert len(found) < 3000 + 200000 / 16
    assert not maybe_in(rows, [F.col("k")], wanted.limit(0), [F.col("k")]).where("_maybe").count()
