"""Quality classifier with hierarchical empirical Bayes.

A logistic model of text features gives each document its own evidence. Over all documents, that
evidence is summed by path and by host. How much paths differ within hosts, and hosts from each
other, beyond what chance within them explains, is estimated from those sums (method of moments, a
nested analysis of variance); the ratio of the two is a prior's strength in documents. A path's
posterior is shrunk toward its host's, a host's toward the global prior, the more the fewer
documents stand behind it. The path's posterior, made without the document itself, takes the place
of the global prior in the document's odds.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, without_ids, written

FEATURES = (
    "log_words", "mean_word", "long_words", "upper", "letters", "digits", "marks", "symbols", "bars", "shouts",
    "distinct", "stutter", "top_word", "repeated_lines", "line_words", "short_lines", "open_lines", "lone_words", "symbol_words", "bar_lines", "shout_words", "stutter_lines",
)
SYMBOLS = frozenset("#$%&*|~^<>{}[]\\@_=+")
SAMPLE = 20_000  # labelled rows that the model is fitted on at most
KEEP = 0.5
EDGE = 1e-4  # posteriors stay so far from 0 and 1
PATHS = 200_000  # so many paths may be broadcast; more are joined by a shuffle
CLIP = 12.0


def character_counts(text: str) -> Counter[str]:
    """How often each character occurs, counted over a million code points at once."""
    total: Counter[str] = Counter()
    for at in range(0, len(text), 1 << 20):
        counts = np.bincount(np.frombuffer(text[at : at + (1 << 20)].encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
        found = np.flatnonzero(counts)
        total.update(dict(zip(map(chr, found.tolist()), counts[found].tolist(), strict=True)))
    return total


def features(text: str | None) -> list[float]:
    """Values of FEATURES for a whole text; all zero where there is no word."""
    text = text or ""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * len(FEATURES)
    counts = character_counts(text)
    letters = upper = digits = symbols = 0
    for c, k in counts.items():
        if c.isalpha():
            letters += k
            if c.isupper():
                upper += k
        elif c.isdigit():
            digits += k
        elif c in SYMBOLS:
            symbols += k
    marks = sum(counts[c] for c in ".,;:!?")
    kinds = Counter(words)
    stutter = sum(map(str.__eq__, words, words[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    m = max(1, len(lines))
    bar_lines = stutter_lines = short_lines = 0
    for x in lines:
        w = x.split()
        short_lines += len(w) < 4
        if x.count("|") >= 2:
            bar_lines += len(w)
        if stutter and len(w) > 3 and 2 * sum(map(str.__eq__, w, w[1:])) > len(w):
            stutter_lines += len(w)
    return [
        math.log(n), letters / n, sum(k for w, k in kinds.items() if len(w) > 20) / n, upper / max(1, letters), letters / size, digits / size, marks / n, symbols / size, counts["|"] / n, counts["!"] / n,
        len(kinds) / n, stutter / n, max(kinds.values()) / n, 1 - len(set(lines)) / m, math.log(n / m), short_lines / m, sum(x.rstrip()[-1] not in ".!?:;\"'" for x in lines) / m,
        sum(k for w, k in kinds.items() if len(w) == 1) / n, sum(k for w, k in kinds.items() if w[-1] in SYMBOLS) / n, bar_lines / n, sum(k for w, k in kinds.items() if len(w) > 1 and w.isupper()) / n, stutter_lines / n,
    ]


def feature_table(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, host, path) -> the same without text, with array x of FEATURES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([features(t.as_py()) for t in b.column(1)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), x], names=["doc_id", "host", "path", "x"])

    return docs.select("doc_id", "text", "host", "path").mapInArrow(run, "doc_id long, host string, path string, x array<double>")


class Model:
    """Ridge logistic regression on standardised features and their squares."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30):
        self.single = len(set(y.tolist())) < 2  # nothing to tell apart: no evidence either way
        if self.single:
            return
        self.mean, self.sd = x.mean(axis=0), x.std(axis=0) + 1e-9
        a = self.inputs(x)
        self.w = np.zeros(a.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(a @ self.w, -30, 30)))
            hessian = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a + ridge * np.eye(a.shape[1])
            step = np.linalg.solve(hessian, a.T @ (y - p) - ridge * self.w)
            self.w += step
            if np.abs(step).max() < 1e-8:
                break

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -6, 6)
        return np.hstack([np.ones((len(z), 1)), z, z**2])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.zeros(len(x)) if self.single else np.clip(self.inputs(x) @ self.w, -CLIP, CLIP)


def fit(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """Fitted on at most `sample` labelled rows, those with the smallest hash of their id; all others are only scored."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    got = rows.select("doc_id", "x").join(known, "doc_id").orderBy("doc_id", "y", "x").limit(sample).collect()  # bounded by sample
    return Model(np.array([r.x for r in got]).reshape(len(got), len(FEATURES)), np.array([r.y for r in got], dtype=float))


def log_odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(EDGE)), F.lit(1 - EDGE))
    return F.log(p / (1 - p))


def strengths(paths: DataFrame) -> tuple[float, float, float]:
    """(global mean, prior strength of hosts, of paths) from paths(host, path, n, s, q): count, sum and sum of squares of the evidence.

    Strengths are in documents; infinite where groups differ no more than chance explains."""
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    p = paths.agg(F.count("*").alias("p"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("ps"), F.sum("q").alias("q"), F.sum(F.col("n").cast("double") * F.col("n")).alias("pnn")).first()
    h = hosts.agg(F.count("*").alias("h"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("hs"), F.sum(F.col("nn") / F.col("n")).alias("hnn"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn")).first()
    if not h.n:
        return 0.5, math.inf, math.inf
    mean = (h.s + 1) / (h.n + 2)
    if h.n <= p.p:
        return mean, math.inf, math.inf
    within = max((p.q - p.ps) / (h.n - p.p), 1e-12)
    of_path = of_host = 0.0
    if p.p > h.h:
        of_path = max(0.0, ((p.ps - h.hs) / (p.p - h.h) - within) / ((h.n - h.hnn) / (p.p - h.h)))
    if h.h > 1:
        of_host = max(0.0, ((h.hs - h.s**2 / h.n) / (h.h - 1) - within - (h.hnn - p.pnn / h.n) / (h.h - 1) * of_path) / ((h.n - h.nn / h.n) / (h.h - 1)))
    ratio = lambda v: within / v if v > 0 else math.inf
    return mean, ratio(of_host), ratio(of_path)


def shrunk(s: Column, n: Column, toward: Column, strength: float) -> Column:
    """Mean of n values of sum s, drawn toward another by `strength` values' worth."""
    if strength == math.inf:
        return toward
    return F.when(n > 0, (s + strength * toward) / (n + strength)).otherwise(toward)


def chance(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", keep: float = KEEP, sample: int = SAMPLE) -> DataFrame:
    """One row per input row: doc_id, evidence (the model's probability), host_posterior, path_posterior, score, keep.

    Null or empty text has zero features; very long texts are read whole. A null host or path is a
    host or path of its own. Without labels, or with one kind only, the evidence is even and all is
    kept. Labels that contradict each other all count. Rows that repeat a doc_id are scored each.
    Other columns are not read, whatever their names. An empty table gives none."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")).alias(n) for c, n in ((host_col, "host"), (path_col, "path"))])
    rows = written(feature_table(base), "features")
    model = fit(rows, labels, sample)

    @F.pandas_udf("double")
    def logit(x):
        return type(x)(model.logit(np.array(x.tolist(), dtype=float).reshape(len(x), len(FEATURES))))

    own = written(rows.select("doc_id", "host", "path", logit("x").alias("logit")), "evidence")
    p = chance(F.col("logit"))
    sums = written(own.groupBy("host", "path").agg(F.sum(p).alias("s"), F.count("*").alias("n"), F.sum(p * p).alias("q")), "paths")
    mean, of_host, of_path = strengths(sums)
    paths = sums.join(sums.groupBy("host").agg(F.sum("s").alias("hs"), F.sum("n").alias("hn")), "host").drop("q")
    s, n, hs, hn = map(F.col, ("s", "n", "hs", "hn"))
    host = shrunk(hs, hn, F.lit(mean), of_host)
    without = shrunk(s - p, n - 1, shrunk(hs - p, hn - 1, F.lit(mean), of_host), of_path)
    score = chance(F.col("logit") + log_odds(without) - log_odds(F.lit(mean)))
    found = own.join(F.broadcast(paths) if sums.count() <= PATHS else paths, ["host", "path"])
    return found.select("doc_id", p.alias("evidence"), host.alias("host_posterior"), shrunk(s, n, host, of_path).alias("path_posterior"), score.alias("score"), (F.lit(True) if model.single else score >= keep).alias("keep"))


def kept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """docs without those that the classifier rejects; all columns stay. Rows that repeat an id stay if one of them is kept."""
    judged = scored(docs, labels, id_col, **how).groupBy("doc_id").agg(F.max("keep").alias("keep"))
    return without_ids(docs, id_col, written(judged.where(~F.col("keep")).select("doc_id"), "rejected"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
