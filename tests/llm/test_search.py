"""Nearest neighbours and URL filtering."""

import duckdb
import numpy as np
import pytest

from kmerweave.llm import neighbours, queries, url_filter
from pyspark.sql import functions as F


def plain_nearest(rows, k):
    usable = {}
    for vec_id, v in rows:
        if vec_id is not None and v and None not in v and np.isfinite(v).all() and any(v):
            usable[vec_id] = np.pad(np.array(v, np.float32).astype(float), (0, 8 - len(v)))
    found = {}
    for q in usable:
        if q % 20 == 0:
            scores = sorted(((-float(usable[q] @ usable[o]), o) for o in usable if o != q))[:k]
            found[q] = [(o, -s) for s, o in scores]
    return found


def test_neighbours_of_odd_vectors_match_brute_force(spark):
    random = np.random.default_rng(3)
    rows = [(n, random.normal(0, 1, 8).round(2).tolist()) for n in range(120)]
    rows += [(200 + n, rows[40][1]) for n in range(60)]
    rows += [(300, None), (301, [0.0] * 8), (302, [1.0, None] + [0.0] * 6), (303, [float("nan")] * 8), (304, []),
             (305, [float("inf")] + [1.0] * 7), (None, rows[3][1]), (320, [1.0, 2.0]), rows[7], rows[7]]
    vectors = spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows],
                                    "vec_id bigint, embedding array<float>, leaf string, vector string, part string")
    found = {}
    for r in neighbours.nearest(vectors, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    wanted = plain_nearest(rows, 20)
    assert found.keys() == wanted.keys()
    for q, best in wanted.items():
        assert [r for r, _, _ in found[q]] == list(range(1, len(best) + 1))
        assert [v for _, v, _ in found[q]] == [v for v, _ in best]
        assert [s for _, _, s in found[q]] == pytest.approx([s for _, s in best])
    assert neighbours.nearest(vectors.where("false"), F.lit(True)).collect() == []
    assert neighbours.nearest(vectors.where("vec_id = 20"), F.lit(True)).collect() == []


def test_recall_with_many_leaves_and_parts(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART", 50)
    random = np.random.default_rng(4)
    centres = random.normal(0, 1, (20, 24))
    points = centres[random.integers(0, 20, 3000)] + random.normal(0, 0.5, (3000, 24))
    vectors = spark.createDataFrame([(n, p.tolist()) for n, p in enumerate(points)], "vec_id bigint, embedding array<double>")
    found = {}
    for r in neighbours.nearest(vectors, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 3000, 20):
        scores = points @ points[q]
        scores[q] = -np.inf
        hits += len(found[q] & set(np.argsort(-scores)[:20].tolist()))
    assert hits / (150 * 20) >= 0.9


def test_forest_finds_a_points_own_leaf_first():
    random = np.random.default_rng(5)
    points = random.normal(0, 1, (500, 6))
    forest = neighbours.grow(points, trees=3, leaf=20)
    leaves = forest.leaves(points)
    for n in range(0, 500, 50):
        assert set(leaves[n]) <= set(forest.search(points[n], 0.9))
    same = neighbours.grow(np.ones((100, 4)), trees=2, leaf=10)
    assert len(same.search(np.ones(4), 1.0)) == 2


URLS = ["http://a.example.org/es/12", "https://A.Example.ORG/en/1", "http://x.com/de/", "http://x.com", "http://x.com?q", None,
        "no scheme", "://", "http://", "ftp://h/a//b/", "http://com/fr/9#x", "http://notexample.org/es/3", "http://ÄB.net/p\nq/1",
        "http://n.net/a/b/c/d/e/f/g/h/1.html", "http://u:p@x.com:80/de/3?y", "a://b://c/d"]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(n, u) for n, u in enumerate(URLS)] + [(3, URLS[3]), (None, URLS[0])]
    rows += [(100 + n, f"http://h{n % 5}.{'org' if n % 3 else 'com'}/{'de' if n % 2 else 'fr'}/{n}") for n in range(300)]
    rows += [(500 + n, f"http://h.net/user{'abcdefghijklmnopqrstuvwxyz'[n % 26]}{'xyz'[n % 3]}/posts") for n in range(40)]
    return spark.createDataFrame([(i, u, "h", "p", "f") for i, u in rows],
                                 "page_id bigint, url string, host string, path string, form string")


def test_rules_hosts_and_paths(pages):
    found = {r.url: r.judged for r in url_filter.judge(pages, queries.URL_RULES).collect()}
    parts = {u: (found[u].host, found[u].path, found[u].rule) for u in URLS}
    assert parts[URLS[0]] == ("a.example.org", "/es/12", "example.org/es/")
    assert parts[URLS[1]] == ("a.example.org", "/en/1", "example.org/en/1")
    assert parts[URLS[2]] == ("x.com", "/de/", "com/de/")
    assert parts[URLS[3]] == ("x.com", "", None) and parts[URLS[4]] == ("x.com", "", None)
    assert parts[None] == parts["no scheme"] == parts["://"] == parts["http://"] == ("", "", None)
    assert parts[URLS[9]] == ("h", "/a//b/", None)
    assert parts[URLS[10]] == ("com", "/fr/9", "com/fr/")
    assert parts[URLS[11]] == ("notexample.org", "/es/3", "org/")
    assert parts[URLS[12]] == ("Äb.net", "/p\nq/1", None)
    assert parts[URLS[14]] == ("u:p@x.com:80", "/de/3", None)
    assert parts[URLS[15]] == ("b:", "//c/d", None)
    for judged in found.values():
        assert judged.verdict == dict((r, v) for v, r in queries.URL_RULES).get(judged.rule, judged.verdict)


def test_judgements_match_sql(pages):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", [[r.page_id, r.url] for r in pages.select("page_id", "url").collect()])
    wanted = sorted(map(str, con.execute(url_filter.sql(queries.URL_RULES)).fetchall()))
    found = url_filter.judge(pages, queries.URL_RULES).select(
        "page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")
    assert sorted(str(tuple(r)) for r in found.collect()) == wanted
    assert len({r[-10:] for r in wanted}) > 1


def test_templates_reject_what_looks_like_blocked_pages(spark):
    rows = [(n, f"http://h{n % 7}.com/{'de' if n % 2 else 'fr'}/{n}") for n in range(400)]
    rows += [(1000, "http://new.net/de/5"), (1001, "http://new.net/fr/5")]
    found = {r.page_id: r.judged for r in url_filter.judge(
        spark.createDataFrame(rows, "page_id bigint, url string"), queries.URL_RULES).collect()}
    assert found[1000].verdict == "block" and found[1000].impurity > 0.9
    assert found[1001].verdict == "allow" and found[1001].impurity < 0.1


def test_empty_table(pages):
    assert url_filter.judge(pages.where("false"), queries.URL_RULES).collect() == []
