"""Vectors, urls and the pipeline."""

import itertools
import math
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from quincunx.llm import queries, urls, vectors
from quincunx.llm.components import connected

FOLDER = "/root/testdata/sf0.001"


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1040)] + [(5000, 5000)]
    parent = {}

    def find(k):
        while parent.setdefault(k, k) != k:
            k = parent[k]
        return k

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: find(k) for k in parent if k != 5000}


# --- vectors ---------------------------------------------------------------------


def brute_links(ids, table, threshold=0.9):
    usable = [v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v) for v in table]
    links, parent = [0] * len(ids), {k: k for k in range(len(ids))}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations([k for k in range(len(ids)) if usable[k] and ids[k] is not None], 2):
        if len(table[a]) != len(table[b]):
            continue
        x, y = (np.array(table[k], float) / np.abs(table[k]).max() for k in (a, b))
        if x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
            links[a] += 1
            links[b] += 1
            i, j = find(a), find(b)
            parent[i if ids[i] > ids[j] else j] = j if ids[i] > ids[j] else i
    return links, [ids[find(k)] for k in range(len(ids))]


@pytest.mark.parametrize("tile, bits", [(2048, None), (3, 2), (2048, 8)])
def test_vectors(spark, monkeypatch, tile, bits):
    monkeypatch.setattr(vectors, "TILE", tile)
    rng = np.random.default_rng(9)
    base = rng.standard_normal((12, 16))
    near = [(base[k % 12] + rng.standard_normal(16) * 0.08).tolist() for k in range(60)]
    table = near + [base[0].tolist()] * 5 + [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [1e200] * 16, [2e200] * 16, [1.0] * 4, [2.0] * 4]
    ids = list(range(100, 100 + len(table)))[::-1]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in zip(ids, table)], "vec_id long, embedding array<double>, bucket int, chunk int, raw string")
    got = {r.vec_id: r for r in vectors.near_vectors(df, bits=bits, recall=0.9999).collect()}
    links, part = brute_links(ids, table)
    assert {i: (got[i].n_links, got[i].component_id, got[i].kept) for i in ids} == {i: (n, c, i == c) for i, n, c in zip(ids, links, part)}


def test_vector_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert vectors.near_vectors(spark.createDataFrame([], schema)).count() == 0
    got = vectors.near_vectors(spark.createDataFrame([(None, [1.0, 2.0]), (3, [1.0, 2.0]), (3, [1.0, 2.0]), (4, None)], schema)).collect()
    assert sorted((repr(r.vec_id), r.n_links, repr(r.component_id)) for r in got) == [("3", 1, "3"), ("3", 1, "3"), ("4", 0, "4"), ("None", 0, "None")]


def test_singles_and_doubles_compare(spark):
    """Vectors kept as single floats meet those that need doubles, and odd lengths keep apart."""
    rng = np.random.default_rng(4)
    single = rng.standard_normal((20, 8)).astype(np.float32).astype(float)
    table = single.tolist() + (single * 1.1).tolist() + single[:, :4].tolist() + (single[:, :4] / 3).tolist()
    assert [len(vectors.packed(np.array(v))) for v in table[::20]] == [32, 65, 16, 33]
    ids = list(range(len(table)))
    df = spark.createDataFrame(list(zip(ids, table)), "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in vectors.near_vectors(df, bits=2, recall=0.99999).collect()}
    links, part = brute_links(ids, table)
    assert {i: (got[i].n_links, got[i].component_id) for i in ids} == {i: (n, c) for i, n, c in zip(ids, links, part)}


def test_signs_do_not_depend_on_the_batch():
    x = np.random.default_rng(5).standard_normal((300, 64)) * 10.0 ** np.random.default_rng(6).integers(-200, 200, 300)[:, None]
    planes = vectors.Hyperplanes(9, 20, 1)
    whole = planes.signs(x, 20)
    assert all((planes.signs(x[k : k + 1], 20) == whole[k]).all() for k in range(0, 300, 7))
    assert (planes.signs(x[:50], 6) == whole[:50, :6]).all() and (whole >= 0).all() and (whole < 512).all()


@pytest.mark.parametrize("pairs", [300, 3_000, 20_000])
def test_recall_of_planted_pairs(spark, pairs):
    """Pairs at cosines of 0.90 to 0.93, where signs agree least; bits and tables follow from the number of rows."""
    rng = np.random.default_rng(pairs)
    x = rng.standard_normal((pairs, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    off = rng.standard_normal((pairs, 64))
    off -= (off * x).sum(axis=1)[:, None] * x
    off /= np.linalg.norm(off, axis=1)[:, None]
    cosine = rng.uniform(0.9 + 1e-9, 0.93, pairs)[:, None]
    both = np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * off])
    if pairs <= 3_000:  # nothing else links
        assert ((both @ both.T >= 0.9).sum() - 2 * pairs) // 2 == pairs
    frame = pd.DataFrame({"vec_id": np.arange(2 * pairs), "embedding": both.tolist()})
    got = vectors.near_vectors(spark.createDataFrame(frame, "vec_id long, embedding array<double>")).toPandas().set_index("vec_id").sort_index()
    linked = got.component_id.to_numpy()[pairs:] == np.arange(pairs)
    assert (got.n_links.to_numpy()[pairs:] == linked).all() and (got.component_id.to_numpy()[:pairs] == np.arange(pairs)).all()
    print(f"recall of {pairs} pairs: {linked.mean():.4f}")
    assert linked.mean() >= 0.97


def test_given_vectors_have_no_links_at_the_threshold(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    x = np.array([r.embedding for r in df.collect()], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert (x @ x.T >= 0.9).sum() == len(x)
    assert {r.n_links for r in vectors.near_vectors(df).collect()} == {0}


# --- urls ------------------------------------------------------------------------


def parse(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")


def ruled(host, path, rules):
    fits = [
        (len(r), r, v) for r, v in rules
        if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])
    ]
    return max(fits)[1:] if fits else (None, None)


ODD = [
    None, "", "no scheme", "://", "http://", "HTTP://A.ORG/x", "http://org/", "http://org", "https://example.org/es/1?a=1#b",
    "http://sub.Example.ORG/en/12", "http://notexample.org/es/", "http://x.com/fr/?a=://y", "http://ÄÖ.com/de/ü", "http://a\nb.com/de/\n?",
    "x?y=http://z.com/de/", "http://a.net/" + "p/" * 3000, "http://u:p@h.org:80/",
]


def test_rules_and_parsing(spark):
    table = [(k, u, "h", "r", 1, 1.0) for k, u in enumerate(ODD * 2)] + [(None, "http://q.com/de/1", None, None, None, None)]
    df = spark.createDataFrame(table, "page_id long, url string, host string, label string, y int, score double")
    got = urls.judged_urls(df, queries.RULES).collect()
    want = Counter()
    for r in table:
        host, path = parse(r[1])
        want[(r[0], host, path, *ruled(host, path, queries.RULES))] += 1
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in got) == want
    assert {r.verdict for r in got} <= {"allow", "block"}
    assert urls.judged_urls(df.limit(0), queries.RULES).count() == 0
    assert {r.verdict for r in urls.judged_urls(df.where("page_id = 2"), queries.RULES).collect()} == {"allow"}


def test_rules_have_the_words_of_the_contract(spark):
    want = {
        "http://a.org/x": "allow", "http://example.org/es/1": "block", "http://example.org/en/1": "block",
        "http://www.example.org/en/12": "block", "http://example.org/en/2": "allow", "http://a.com/fr/1": "allow", "http://a.com/de/1": "block",
    }
    df = spark.createDataFrame(list(enumerate(want)), "page_id long, url string")
    got = urls.judged_urls(df, queries.RULES).collect()
    assert {list(want)[r.page_id]: r.verdict for r in got} == want and all(r.rule for r in got)


def test_a_frequent_url_does_not_fill_the_sample(spark):
    """4 000 pages of one ruled url beside 400 others; room for 300 rows."""
    allowed = [(k, f"http://w{k}.com/fr/{'a/' * (k % 5)}") for k in range(200)]
    blocked = [(200 + k, f"http://w{k}.com/de/{k * 7919}/?a={k}&b=1") for k in range(200)]
    judged = [(400 + k, f"http://v{k}.net/{k * 104729}/?a={k}&b=1") for k in range(50)]
    rows = allowed + blocked + judged
    often = [(10_000 + k, url) for _, url in allowed[:20] for k in range(200)]
    verdicts = []
    for table in (rows, rows + often):
        df = spark.createDataFrame(table, "page_id long, url string")
        got = urls.judged_urls(df, queries.RULES, most=300).where("page_id >= 400 AND page_id < 450").collect()
        assert len(got) == 50
        verdicts.append({r.verdict for r in got})
    assert verdicts == [{"block"}, {"block"}]


def test_trees_learn_held_out_urls(spark):
    pages = [(k, f"http://{'casino-win' if k % 3 == 0 else 'news'}{k % 7}.example.net/en/{k}{'?a=1&b=2' if k % 3 == 0 else ''}") for k in range(600)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    rows = urls.parsed(df, "page_id", "url").selectExpr("*", "if(page_id % 2 = 0, named_struct('rule', 'x', 'verdict', if(page_id % 3 = 0, 'block', 'allow')), NULL) AS label")
    rows = urls.with_features(rows)
    train = rows.where("label IS NOT NULL").selectExpr("*", "cast(label.verdict = 'block' AS double) AS y").select("y", *urls.FEATURES)
    score = urls.fit_trees(train, "y", urls.FEATURES)
    test = rows.where("label IS NULL").select("page_id", (score > 0).alias("b")).collect()
    assert sum(r.b == (r.page_id % 3 == 0) for r in test) > 0.97 * len(test)


# --- the pipeline ----------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    if not Path(FOLDER).exists():
        pytest.skip("the given tables are not here")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(kept) == len(set(kept)) and set(kept) <= ids
        ids = set(kept)
        counts.append(len(ids))
    assert counts[0] > counts[1] > counts[2] == counts[3] > counts[4] > 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == ids
    assert corpus_pipeline.run(spark, FOLDER).count() == pieces.count()
