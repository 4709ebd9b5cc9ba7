"""URL filters: host and path rules, and gradient-boosted trees for the rest.

The longest rule that fits decides. All other URLs are judged by boosted trees over
lexical features (lengths, depth, digit ratio, entropy, parameter counts, statistics of
the host's suffix), trained on the URLs that a rule decides. Suffix statistics are counted
over the whole table, combined before they are shuffled; the training rows are a bounded
sample (``PER_LABEL`` of each verdict, drawn by hash). Scoring is one pass.

Defined cases: a null URL or one without ``://`` has an empty host and path, which no
rule fits; without labelled URLs of both verdicts every other URL gets the one verdict
there is, or ``allow``; repeated rows and ids are rows of their own; other columns of the
input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, lower_ascii

PER_LABEL = 10_000
AT_MOST = 20_000
ROUNDS = 60
DEPTH = 3
RATE = 0.2
BINS = 32

RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest) + 1), r"\A[^?#]*", 0)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def decide(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


FEATURES = 13


def features(url: list[str | None], host: list[str], path: list[str], blocked: np.ndarray) -> np.ndarray:
    out = np.zeros((len(url), FEATURES))
    for i, (u, h, p) in enumerate(zip(url, host, path)):
        u = u or ""
        query = u.partition("#")[0].partition("?")[2]
        counts = np.unique(np.frombuffer(u.encode("utf-8"), np.uint8), return_counts=True)[1] if u else np.ones(1)
        share = counts / counts.sum()
        last = p.rpartition("/")[2]
        out[i, :11] = (
            len(u),
            len(h),
            len(p),
            h.count(".") + bool(h),
            sum(bool(x) for x in p.split("/")),
            sum(c.isdigit() for c in u) / max(1, len(u)),
            sum(c.isdigit() for c in h) / max(1, len(h)),
            float(-(share * np.log2(share)).sum()),
            query.count("=") + query.count("&"),
            h.count("-"),
            len(last.rpartition(".")[2]) if "." in last else 0,
        )
    # The suffix itself: its length, and the share of blocked URLs among those that a rule decides.
    out[:, 11], out[:, 12] = [len(h.rpartition(".")[2]) for h in host], blocked
    return out


class Boosted:
    """Trees of a logistic loss; each is a list of (feature, cut, left, right) or a leaf's value."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        self.trees = []
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        codes = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
        score = np.full(len(x), self.start)
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-score))
            tree: list = []
            self._grow(tree, codes, cuts, p - y, np.maximum(p * (1 - p), 1e-6), np.arange(len(x)), 0)
            self.trees.append(tree)
            score += self._tree(tree, x)

    def _grow(self, tree, codes, cuts, g, h, rows, depth) -> int:
        me = len(tree)
        tree.append(-RATE * g[rows].sum() / (h[rows].sum() + 1.0))
        best = (1e-3, None)
        if depth < DEPTH and len(rows) > 20:
            whole = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
            for f, c in enumerate(cuts):
                gs = np.cumsum(np.bincount(codes[rows, f], g[rows], len(c) + 1))
                hs = np.cumsum(np.bincount(codes[rows, f], h[rows], len(c) + 1))
                gain = gs[:-1] ** 2 / (hs[:-1] + 1) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1) - whole
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), (f, int(gain.argmax())))
        if best[1]:
            f, k = best[1]
            low = codes[rows, f] <= k
            left = self._grow(tree, codes, cuts, g, h, rows[low], depth + 1)
            right = self._grow(tree, codes, cuts, g, h, rows[~low], depth + 1)
            tree[me] = (f, float(cuts[f][k]), left, right)
        return me

    @staticmethod
    def _tree(tree: list, x: np.ndarray) -> np.ndarray:
        out, stack = np.zeros(len(x)), [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if isinstance(tree[node], float):
                out[rows] = tree[node]
            elif len(rows):
                f, cut, left, right = tree[node]
                low = x[rows, f] <= cut
                stack += [(left, rows[low]), (right, rows[~low])]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.start + sum(self._tree(t, x) for t in self.trees))))


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, score``: score is the trees' probability of ``block``."""
    spark = SparkSession.active()
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), host.alias("host"), path.alias("path"))
    rule, said = decide(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("said", said)
    rows = rows.withColumn("suffix", F.substring_index("host", ".", -2))
    labelled = F.col("said").isNotNull()
    stats = rows.groupBy("suffix").agg(
        ((F.count(F.when(F.col("said") == "block", 1)) + 1) / (F.count(F.when(labelled, 1)) + 2)).alias("blocked"),
    )
    known = rows.join(stats, "suffix")
    kind = rows.schema["page_id"].dataType.simpleString()
    chosen = bounded_sample(known.where(labelled), "said", "url", PER_LABEL, AT_MOST)
    got = chosen.select("url", "host", "path", "blocked", "said").toArrow().sort_by("url").to_pydict()
    model = None
    if len(set(got["said"])) == 2:
        x = features(got["url"], got["host"], got["path"], np.array(got["blocked"]))
        model = Boosted(x, np.array([s == "block" for s in got["said"]], float))
    plain = 1.0 if set(got["said"]) == {"block"} else 0.0
    shared = spark.sparkContext.broadcast(model)  # ROUNDS trees of DEPTH levels

    def run(batches):
        for b in batches:
            get = lambda n: b.column(n).to_pylist()  # noqa: B023, E731
            if shared.value is None:
                p = np.full(b.num_rows, plain)
            else:
                x = features(get("url"), get("host"), get("path"), np.array(get("blocked"), float))
                p = shared.value.probability(x) if b.num_rows else np.zeros(0)
            verdict = [s or ("block" if q >= 0.5 else "allow") for s, q in zip(get("said"), p)]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("host"), b.column("path"), b.column("rule"), pa.array(verdict, pa.string()), pa.array(p, pa.float64())],
                ["page_id", "host", "path", "rule", "verdict", "score"],
            )

    wanted = known.select("page_id", "url", "host", "path", "rule", "said", "blocked")
    return wanted.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, score double")
