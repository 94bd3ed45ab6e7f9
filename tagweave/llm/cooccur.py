"""Items that appear together more often than chance: exact pair counts against a fitted null.

The null is the bipartite configuration model: item i is in basket j with probability
x_i y_j / (1 + x_i y_j), independently, with x and y such that every item is expected in as many
baskets as it is in, and every basket to hold as many items as it holds. Under it the count of a
pair is Poisson-binomial; its upper tail comes from the saddlepoint approximation, and the
Benjamini-Hochberg procedure over all pairs of tested items controls the false-discovery rate.

Items of equal frequency and baskets of equal size have equal parameters, so the fit runs on
classes; frequencies above 1000 and sizes above 100 share a class when they agree in their first three
and two digits. Their number is bounded whatever the data (900 and 90 per power of ten).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.operators.nodes import ordered_index
from tagweave.session import cut

WIDE = 1_000
JUDGED = 1_000  # combinations of counts at a time


def rounded(n: Column, digits: int, exact: int) -> Column:
    scale = F.pow(F.lit(10.0), F.floor(F.log10(n.cast("double"))) - (digits - 1))
    return F.when(n <= exact, n.cast("long")).otherwise((F.floor(n / scale) * scale).cast("long"))


@dataclass(frozen=True)
class Null:
    """The fitted model: log x by log frequency, and y with the number of baskets by size class."""

    log_d: np.ndarray
    log_x: np.ndarray
    y: np.ndarray
    m: np.ndarray

    def fitness(self, d: np.ndarray) -> np.ndarray:
        return np.exp(np.interp(np.log(np.maximum(d, 1)), self.log_d, self.log_x))

    def chances(self, d: np.ndarray) -> np.ndarray:
        """Of each item (by frequency) its chance to be in a basket of each size class."""
        xy = self.fitness(d)[:, None] * self.y[None, :]
        return xy / (1 + xy)


def fit_null(d: np.ndarray, c: np.ndarray, k: np.ndarray, m: np.ndarray, rounds: int = 2_000, tolerance: float = 1e-9) -> Null:
    """Fixed-point iteration on classes: c items in d baskets each, m baskets of k items each."""
    d, c, k, m = (np.asarray(v, float) for v in (d, c, k, m))
    n_baskets, n_items = m.sum(), c.sum()
    d, k = np.minimum(d, n_baskets * (1 - 1e-9)), np.minimum(k, n_items * (1 - 1e-9))
    total = math.sqrt((c * d).sum())
    x, y = d / total, k / total
    for _ in range(rounds):
        old = x, y
        x = d / (m * y / (1 + np.outer(x, y))).sum(1)
        y = k / (c[:, None] * x[:, None] / (1 + np.outer(x, y))).sum(0)
        if max(np.max(np.abs(x / old[0] - 1)), np.max(np.abs(y / old[1] - 1))) < tolerance:
            break
    order = np.argsort(d)
    return Null(np.log(d[order]), np.log(x[order]), y, m)


def _log_mills(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(R, R - 1/w) of Mills' ratio R = (1 - Phi(w)) / phi(w), w > 0, without cancellation for large w."""
    small = np.minimum(w, 6.0)
    tail = np.array([0.5 * math.erfc(v / math.sqrt(2)) for v in small])
    exact = tail / (np.exp(-0.5 * small**2) / math.sqrt(2 * math.pi))
    big = np.maximum(w, 6.0)
    less = -1 / big**3 + 3 / big**5 - 15 / big**7 + 105 / big**9
    return np.where(w < 6, exact, 1 / big + less), np.where(w < 6, exact - 1 / np.maximum(w, 1e-300), less)


def log_tail(n: np.ndarray, q: np.ndarray, m: np.ndarray, steps: int = 60) -> np.ndarray:
    """log P(X >= n) for X a sum of m[s] trials with chance q[:, s] each: the Lugannani-Rice formula for
    lattice variables; a count not above the mean has log 0.5 at least and is given as 0."""
    n = np.asarray(n, float)
    mean = (q * m).sum(1)
    most = m.sum()
    out = np.zeros(len(n))
    at = np.flatnonzero(n > mean + 1e-9)
    if not len(at):
        return out
    n, q, mean = n[at], np.clip(q[at], 1e-300, 1 - 1e-12), mean[at]
    goal = np.minimum(n, most * (1 - 1e-9))
    t = np.zeros(len(at))
    low, high = np.zeros(len(at)), np.full(len(at), 60.0)
    for _ in range(steps):
        z = q * np.exp(t)[:, None]
        p = z / (1 - q + z)
        slope, curve = (p * m).sum(1), (p * (1 - p) * m).sum(1)
        low, high = np.where(slope < goal, t, low), np.where(slope >= goal, t, high)
        step = t - (slope - goal) / np.maximum(curve, 1e-300)
        new = np.where((step > low) & (step < high), step, (low + high) / 2)
        if np.max(np.abs(new - t)) < 1e-12:
            break
        t = new
    z = q * np.exp(t)[:, None]
    p = z / (1 - q + z)
    curve = np.maximum((p * (1 - p) * m).sum(1), 1e-300)
    w2 = 2 * (t * goal - (np.log1p(q * np.expm1(t)[:, None]) * m).sum(1))
    w = np.sqrt(np.maximum(w2, 1e-18))
    u = -np.expm1(-t) * np.sqrt(curve)
    _, less = _log_mills(w)
    value = 1 / np.maximum(u, 1e-300) + less
    rice = -0.5 * w2 - 0.5 * math.log(2 * math.pi) + np.log(np.maximum(value, 1e-300))
    # beside the mean the formula is a difference of poles; the normal tail with half a step serves
    sd = np.sqrt(np.maximum((q * (1 - q) * m).sum(1), 1e-300))
    plain = np.log(np.maximum([0.5 * math.erfc(v / math.sqrt(2)) for v in (n - 0.5 - mean) / sd], 1e-300))
    out[at] = np.minimum(0.0, np.where(w < 0.05, plain, rice))
    return out


def baskets(rows: DataFrame, basket: str = "id", item: str = "tag") -> DataFrame:
    """(id, items): the distinct items of each basket; rows with a null are left out."""
    live = rows.select(F.col(basket).alias("id"), F.col(item).alias("item")).dropna()
    return live.groupBy("id").agg(F.array_sort(F.collect_set("item")).alias("items"))


def pair_counts(coded: DataFrame, wide: int = WIDE) -> DataFrame:
    """(a, b, n_ab) of baskets (id, codes), codes sorted: pairs are numbered as one long, generated one
    at a time and counted before the shuffle. Baskets of more than `wide` items are first spread, one
    row per first item, over all tasks."""

    def pairs(df: DataFrame) -> DataFrame:
        behind = F.transform(F.slice("codes", F.col("i") + 2, F.size("codes")), lambda y: F.shiftleft(F.col("x"), 32) + y)
        return df.select(F.explode(behind).alias("pair"))

    narrow = coded.filter(F.size("codes").between(2, wide)).select("codes", F.posexplode("codes").alias("i", "x"))
    big = coded.filter(F.size("codes") > wide).select("id", "codes", F.posexplode("codes").alias("i", "x")).repartition("id", "i").drop("id")
    counted = pairs(narrow).unionByName(pairs(big)).groupBy("pair").agg(F.count(F.lit(1)).alias("n_ab"))
    return counted.select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b"), "n_ab")


def cooccurrences(rows: DataFrame, basket: str = "id", item: str = "tag", min_count: int = 5, min_share: float = 0.0, rate: float = 0.01) -> DataFrame:
    """(item_a, item_b, n, n_a, n_b, n_ab, lift, expected, log10_p, significant) of every pair of items
    that at least max(min_count, min_share * n) of the n baskets hold, item_a < item_b.

    lift is n_ab * n / (n_a * n_b); expected and log10_p (of the upper tail) are those of the null;
    `significant` marks a false-discovery rate of at most `rate` over all pairs of items that are
    frequent enough to be in such a pair. Items below the least count can't be in such a pair and
    are left out before pairs are made, which loses none. Rows with a null are left out, repeated
    rows count once, an empty table gives no row.
    """
    whole = cut(baskets(rows, basket, item))
    degree = whole.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("d"))
    items = cut(degree)
    d_class = rounded(F.col("d"), 3, 1000)
    d_rows = items.groupBy(d_class.alias("g")).agg(F.count(F.lit(1)).alias("c"), F.avg("d").alias("d")).collect()
    k_class = rounded(F.size("items"), 2, 100)
    k_rows = whole.groupBy(k_class.alias("g")).agg(F.count(F.lit(1)).alias("m"), F.avg(F.size("items")).alias("k")).collect()
    n = sum(r.m for r in k_rows)
    schema = "item_a string, item_b string, n bigint, n_a bigint, n_b bigint, n_ab bigint, lift double, expected double, log10_p double"
    if not n:
        return rows.sparkSession.createDataFrame([], schema + ", significant boolean")
    null = fit_null(*(np.array([r[f] for r in src]) for src, f in ((d_rows, "d"), (d_rows, "c"), (k_rows, "k"), (k_rows, "m"))))
    need = max(min_count, math.ceil(min_share * n - 1e-9))
    # items get numbers in the order of their text
    kept = cut(ordered_index(items.filter(F.col("d") >= need), "item").select("item", "d", F.col("i").alias("code")))
    tested = kept.count()
    lookup = kept.select("item", "code")
    coded = cut(whole.select("id", F.explode("items").alias("item")).join(lookup, "item").groupBy("id").agg(F.sort_array(F.collect_list("code")).alias("codes")))
    counted = pair_counts(coded).filter(F.col("n_ab") >= need)
    sized = counted.join(kept.select(F.col("code").alias("a"), F.col("d").alias("n_a")), "a").join(kept.select(F.col("code").alias("b"), F.col("d").alias("n_b")), "b")
    named = counted.join(kept.select(F.col("code").alias("a"), F.col("item").alias("item_a"), F.col("d").alias("n_a")), "a").join(kept.select(F.col("code").alias("b"), F.col("item").alias("item_b"), F.col("d").alias("n_b")), "b")

    def judge(p: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """(expected, log10 of the upper tail) of each row; rows of equal counts are judged together."""
        kinds, at = np.unique(p[["n_a", "n_b", "n_ab"]].to_numpy(), axis=0, return_inverse=True)
        expected, tail = np.empty(len(kinds)), np.empty(len(kinds))
        for i in range(0, len(kinds), JUDGED):
            n_a, n_b, n_ab = kinds[i : i + JUDGED].T
            q = null.chances(n_a) * null.chances(n_b)
            expected[i : i + JUDGED], tail[i : i + JUDGED] = (q * null.m).sum(1), log_tail(n_ab, q, null.m)
        at = at.reshape(-1)
        return expected[at], (tail / math.log(10))[at]

    def tails(batches):
        for p in batches:
            if len(p):
                yield pd.DataFrame({"log10_p": judge(p)[1], "times": p["times"]})

    def surprise(batches):
        for p in batches:
            if not len(p):
                continue
            out = pd.DataFrame({c: p[c] for c in ("item_a", "item_b", "n_a", "n_b", "n_ab")})
            out.insert(2, "n", n)
            out["lift"] = p["n_ab"] * float(n) / (p["n_a"].astype(float) * p["n_b"])
            out["expected"], out["log10_p"] = judge(p)
            yield out

    # the pairs can be far more than the rows: they are counted twice, from the stored codes of the
    # baskets, and never stored; the threshold
    # needs how often each combination of counts occurs only
    kinds = sized.groupBy("n_a", "n_b", "n_ab").agg(F.count(F.lit(1)).alias("times"))
    threshold = threshold_log10(kinds.mapInPandas(tails, "log10_p double, times bigint"), tested * (tested - 1) // 2, rate)
    judged = named.select("item_a", "item_b", "n_a", "n_b", "n_ab").mapInPandas(surprise, schema)
    return judged.withColumn("significant", F.col("log10_p") <= F.lit(threshold))


def threshold_log10(tails: DataFrame, hypotheses: int, rate: float) -> float:
    """The Benjamini-Hochberg threshold on log10 p, from a histogram of at most 10,000 bins of 0.01; a
    bin counts with its largest p, so the rate is kept. `tails` has rows (log10_p, times); pairs that
    aren't in it count as p = 1."""
    bin_of = F.least(F.floor(-F.col("log10_p") * 100), F.lit(9_999)).cast("int")
    bins = sorted(((r.b, r.n) for r in tails.groupBy(bin_of.alias("b")).agg(F.sum("times").alias("n")).collect()), reverse=True)
    seen, best = 0, -math.inf
    for b, k in bins:
        seen += k
        if -b / 100 <= math.log10(rate * seen / max(1, hypotheses)):
            best = -b / 100
    return best
