import numpy as np
from pyspark.sql import functions as F

from strandlake.llm import quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    got = quality.scored(docs, labels.where(half)).join(labels.where(~half), "doc_id").collect()
    right = np.mean([r.keep == bool(r.quality) for r in got])
    assert len(got) > 100 and right > 0.97
    assert np.mean([r.keep for r in got if r.quality]) > 0.97


def plain_scores(rows, edge=quality.EDGE):
    """{doc: (host posterior, path posterior, score)} of rows (doc, host, path, logit), by plain code."""
    chance = lambda x: 1 / (1 + np.exp(-x))
    odds = lambda q: np.log(min(max(q, edge), 1 - edge) / (1 - min(max(q, edge), 1 - edge)))
    by_path, by_host = {}, {}
    for _, h, p, x in rows:
        by_path.setdefault((h, p), []).append(chance(x))
        by_host.setdefault(h, []).append(chance(x))
    n = len(rows)
    g = (sum(map(sum, by_host.values())) + 1) / (n + 2)
    within = sum(((np.array(v) - np.mean(v)) ** 2).sum() for v in by_path.values()) / (n - len(by_path))
    mid = sum(len(v) * (np.mean(v) - np.mean(by_host[h])) ** 2 for (h, _), v in by_path.items()) / (len(by_path) - len(by_host))
    top = sum(len(v) * (np.mean(v) - np.mean(sum(by_host.values(), []))) ** 2 for v in by_host.values()) / (len(by_host) - 1)
    nested = sum(len(v) ** 2 / len(by_host[h]) for (h, _), v in by_path.items())
    of_path = max(0, (mid - within) / ((n - nested) / (len(by_path) - len(by_host))))
    of_host = max(0, (top - within - (nested - sum(len(v) ** 2 for v in by_path.values()) / n) / (len(by_host) - 1) * of_path) / ((n - sum(len(v) ** 2 for v in by_host.values()) / n) / (len(by_host) - 1)))

    def drawn(values, toward, variance):
        k = within / variance if variance else np.inf
        return toward if k == np.inf or not values else (sum(values) + k * toward) / (len(values) + k)

    out = {}
    for d, h, p, x in rows:
        others = lambda v, x=x: [y for i, y in enumerate(v) if i != v.index(chance(x))]
        host = drawn(by_host[h], g, of_host)
        alone = drawn(others(by_path[h, p]), drawn(others(by_host[h]), g, of_host), of_path)
        out[d] = host, drawn(by_path[h, p], host, of_path), chance(x + odds(alone) - odds(g))
    return out


def planted(seed=3, n=1200):
    """Texts that hardly tell; hosts and paths that do. The last ten hosts are sparse."""
    rng = np.random.default_rng(seed)
    rate = {(h, p): float(np.clip(rng.beta(0.6, 0.6) + 0.15 * (p == "a"), 0.02, 0.98)) for h in range(40) for p in "ab"}
    docs, labels = [], []
    for i in range(n):
        h, p = int(rng.integers(0, 30)) if i % 40 else 30 + int(rng.integers(0, 10)), "ab"[int(rng.integers(0, 2))]
        y = int(rng.random() < rate[h, p])
        words = rng.integers(3, 9, int(rng.integers(20, 60)))
        odd = int(rng.random() < (0.3 if y else 0.75))
        docs.append((i, " ".join(["x" * k for k in words] + ["#$%"] * (odd * int(rng.integers(1, 5)))), f"h{h}", p))
        labels.append((i, y))
    return docs, labels


def test_scores_match_plain_code(spark):
    docs, labels = planted()
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    got = {r.doc_id: r for r in quality.scored(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    y = dict(labels)
    model = quality.Model(np.array([quality.features(t) for _, t, *_ in docs]), np.array([y[d] for d, *_ in docs], dtype=float))
    logit = model.logit(np.array([quality.features(t) for _, t, *_ in docs]))
    want = plain_scores([(d, h, p, x) for (d, _, h, p), x in zip(docs, logit, strict=True)])
    for d, w in want.items():
        r = got[d]
        assert np.allclose((r.host_posterior, r.path_posterior, r.score), w, atol=1e-6) and r.keep == (r.score >= 0.5)


def test_groups_help_where_they_differ(spark):
    """Held out: the posteriors of hosts and paths change decisions for the better, in sparse hosts too."""
    docs, labels = planted(n=3000)
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    known = spark.createDataFrame([x for x in labels if x[0] % 2], "doc_id long, quality int")
    y = dict(labels)
    got = [r for r in quality.scored(df, known).collect() if r.doc_id % 2 == 0]
    alone, joint = (np.mean([(c(r) >= 0.5) == y[r.doc_id] for r in got]) for c in (lambda r: r.evidence, lambda r: r.score))
    changed = [r for r in got if (r.evidence >= 0.5) != r.keep]
    print(f"held out: {alone:.3f} alone, {joint:.3f} with hosts and paths; {len(changed)} of {len(got)} decisions changed")
    assert len(changed) > 30 and joint > alone + 0.005
    # sparse paths lie nearer to their host than their own mean does
    kept = quality.kept(df, known)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.scored(df, known).where("keep").collect()}


def test_groups_that_do_not_differ_count_for_nothing():
    rng = np.random.default_rng(1)
    values = [("h%d" % (i % 20), "p%d" % (i % 3), float(x)) for i, x in enumerate(rng.normal(size=4000))]
    found = plain_scores([(i, h, p, x) for i, (h, p, x) in enumerate(values)])
    assert np.mean([abs(1 / (1 + np.exp(-values[i][2])) - s) for i, (*_, s) in found.items()]) < 0.01


def test_odd_rows(spark):
    rows = [(1, None, None, None), (2, "", "a", "b"), (2, "x", "a", None), (None, "some text here", "a", "b"), (5, "w " * 100000, "c", "b"), (6, "$$$ ### " * 50, "c", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumns({c: F.lit(1) for c in ("host", "x", "__at", "__sums", "__logit", "keep")})
    labels = spark.createDataFrame([(6, 0), (5, 1), (2, 1), (2, 0), (99, 1), (None, 1), (1, None)], "doc_id long, quality int")
    assert quality.scored(df, labels).count() == len(rows)
    out = quality.kept(df, labels)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} <= {1, 2, 5, 6, None}
    assert quality.kept(df, labels.limit(0)).count() == len(rows)
    assert quality.kept(df, labels.where("quality = 1")).count() == len(rows)
    assert quality.scored(df.limit(0), labels).count() == 0
