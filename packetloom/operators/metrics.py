"""Metrics and statistics over packets; what is undefined is null, never 0."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from math import exp, lgamma, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions import text as T
from packetloom.runtime import round6

SIGNS_EXACT, SIGNS, DRAWS, ALPHA = 16, 9_999, 4_000, 0.05


def _share(part: Column, whole: Column) -> Column:
    return round6(F.size(part) / F.nullif(F.size(whole), F.lit(0)))


def recall(gold: Column, served: Column) -> Column:
    """Share of the gold ids that were served; null without gold."""
    return _share(F.array_intersect(gold, served), F.array_distinct(gold))


def closure_recall(sources: Column, seeds: Column, reached: Column) -> Column:
    """Share of the sources beside the seeds that the closure reached; null where there are none."""
    return recall(F.array_except(sources, seeds), reached)


def closure_precision(required: Column, gold: Column) -> Column:
    """Share of what the closure requires that is gold; null where it requires nothing or there is no gold."""
    return F.when(F.size(gold) > 0, _share(F.array_intersect(required, gold), F.array_distinct(required)))


def macro(rows: DataFrame, *metrics: str) -> DataFrame:
    """Mean over the items on which a metric is defined, and their number."""
    return rows.agg(*[x for m in metrics for x in (round6(F.avg(m)).alias(m), F.count(m).alias(f"n_{m}"))])


def micro(rows: DataFrame, part: str, whole: str) -> DataFrame:
    """Pooled ratio of two counts."""
    return rows.agg(round6(F.sum(part) / F.nullif(F.sum(whole), F.lit(0))).alias("ratio"))


def stale_leakage(rows: DataFrame) -> DataFrame:
    """Share of the items with superseded ids whose packet holds one; questions of audits may. ``rows``: query_mode, stale, served."""
    d = rows.filter((F.size("stale") > 0) & (F.coalesce("query_mode", F.lit("lookup")) != "audit"))
    return d.agg(round6(F.avg(F.arrays_overlap("stale", "served").cast("int"))).alias("rate"), F.count("*").alias("n"))


def inflation(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pooled tokens of arm a over those of arm b on the items of both (item_id, tokens)."""
    return a.select("item_id", F.col("tokens").alias("x")).join(b.select("item_id", F.col("tokens").alias("y")), "item_id").agg(round6(F.sum("x") / F.nullif(F.sum("y"), F.lit(0))).alias("ratio"), F.count("*").alias("n"))


def packet_rates(rows: DataFrame) -> DataFrame:
    """Shares of packets above their budget (which must be 0) and of incomplete ones. ``rows``: total_tokens, budget, incomplete."""
    return rows.agg(round6(F.avg((F.col("total_tokens") > F.col("budget")).cast("int"))).alias("over_budget"), round6(F.avg(F.col("incomplete").cast("int"))).alias("incomplete"), F.count("*").alias("n"))


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """(item_id, a, b) of two arms' correctness; raises where an item is missing in one arm or stands twice in one."""
    d = a.groupBy("item_id").agg(F.max("correct").alias("a"), F.count("*").alias("na")).join(b.groupBy("item_id").agg(F.max("correct").alias("b"), F.count("*").alias("nb")), "item_id", "full")
    fine = (F.coalesce("na", F.lit(0)) == 1) & (F.coalesce("nb", F.lit(0)) == 1)
    return d.select(F.when(fine, F.col("item_id")).otherwise(F.raise_error(F.concat(F.lit("arms differ at item "), "item_id"))).alias("item_id"), "a", "b")


def normal_answer(c: Column) -> Column:
    """An answer in lower case, white space as one blank, without marks and quotes at the ends."""
    edge = r"[\s\"'`.,;:!?()\[\]{}<>*_-]+"
    return F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "), f"^{edge}", "")), f"{edge}$", "")


def answer_matches(answer: Column, gold: Column) -> Column:
    """Whether the gold answer stands in the answer, both in normal form; an empty one never does."""
    return (normal_answer(gold) != "") & F.contains(normal_answer(answer), normal_answer(gold))


def confusion(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1) of every label seen."""
    labels = rows.select(F.col(truth).alias("label")).union(rows.select(F.col(guess))).filter("label is not null").distinct()
    t = rows.groupBy(F.col(truth).alias("label")).agg(F.count("*").alias("n_true"), F.count_if(F.col(truth) == F.col(guess)).alias("tp"))
    g = rows.groupBy(F.col(guess).alias("label")).agg(F.count("*").alias("n_guess"))
    d = labels.join(t, "label", "left").join(g, "label", "left").na.fill(0, ["n_true", "tp", "n_guess"])
    p, r = F.col("tp") / F.nullif("n_guess", F.lit(0)), F.col("tp") / F.nullif("n_true", F.lit(0))
    return d.select("label", "tp", (F.col("n_guess") - F.col("tp")).alias("fp"), (F.col("n_true") - F.col("tp")).alias("fn"), round6(p).alias("precision"), round6(r).alias("recall"), round6(2 * p * r / F.nullif(p + r, F.lit(0.0))).alias("f1"))


def macro_f1(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """Mean F1 over the labels seen, where an undefined one counts as 0, and accuracy."""
    f1 = confusion(rows, truth, guess).agg(round6(F.avg(F.coalesce("f1", F.lit(0.0)))).alias("macro_f1"), F.count("*").alias("n_labels"))
    return f1.crossJoin(rows.agg(round6(F.avg((F.col(truth) == F.col(guess)).cast("int"))).alias("accuracy")))  # one row each


# --- what the arms say about an item -------------------------------------------------------------------------------------
LABELS = ("budget_overflow", "task_or_reader_failure", "routing_miss", "closure_miss", "edge_coverage_miss", "carrier_loss", "reader_miss", "stale_conflict", "ok", "ambiguous")


def attribution(arms: DataFrame) -> DataFrame:
    """(item_id, label, confident): the first of ten rules that an item's arms meet.

    ``arms``: item_id, arm (A0_null, A0_shuffled, A1, A2, A3, A4, B1 … B4), correct and, where measured, incomplete,
    n_missing, probe_positive, stale_hit, n_carrier_slots, frozen_key, vacuous. Arms that were not run are absent.
    """
    names = ("A0_null", "A0_shuffled", "A1", "A2", "A3", "A4", "B1", "B2", "B3", "B4")
    flags = {"correct": "boolean", "incomplete": "boolean", "n_missing": "long", "probe_positive": "boolean", "stale_hit": "boolean", "n_carrier_slots": "long", "frozen_key": "string", "vacuous": "boolean"}
    d = arms.select("item_id", "arm", *[(F.col(f) if f in arms.columns else F.lit(None)).cast(t).alias(f) for f, t in flags.items()])
    p = d.groupBy("item_id").pivot("arm", list(names)).agg(F.first(F.struct(*flags)))
    ok = lambda a: F.coalesce(F.col(f"{a}.correct"), F.lit(False))
    bad = lambda a: F.coalesce(~F.col(f"{a}.correct"), F.lit(False))
    on = lambda a, f: F.coalesce(F.col(f"{a}.{f}"), F.lit(False))
    leak = ok("A0_null") | ok("A0_shuffled")
    over = lambda a: on(a, "incomplete") & bad(a)
    named = lambda a: F.coalesce(F.col(f"{a}.n_missing"), F.lit(0)) > 0
    b = ("B1", "B2", "B3", "B4")
    keys = F.array_distinct(F.filter(F.array(*[F.col(f"{x}.frozen_key") for x in b]), lambda x: F.coalesce(x, F.lit("")) != ""))
    frozen = F.size(keys) == 1
    carrier = bad("B2") & (F.coalesce(F.col("B2.n_carrier_slots"), F.lit(1)) > 0)
    probe = on("B2", "probe_positive")
    stale = [F.col(f"{x}.stale_hit") for x in names]
    hit = F.coalesce(F.greatest(*[F.coalesce(s, F.lit(False)) for s in stale]), F.lit(False))
    order = ("B4", *[x for x in names if x != "B4"])
    vacuous = F.coalesce(*[F.when(on(x, "stale_hit"), on(x, "vacuous")) for x in order], F.lit(False))
    default = F.coalesce(*[F.col(f"{x}.correct") for x in ("A2", "A3", "A1", "A4", "B1")])
    none = F.lit(True)
    for x in names:
        none = none & F.col(x).isNull()
    rules = [
        (none, "ambiguous", F.lit(False)), (over("A2"), "budget_overflow", named("A2") & ~leak), (over("A3"), "budget_overflow", named("A3") & ~leak), (bad("A4"), "task_or_reader_failure", ~leak),
        (ok("A3") & bad("A2"), "routing_miss", ~leak), (ok("A2") & bad("A1"), "closure_miss", ~leak), (ok("A4") & bad("A3"), "edge_coverage_miss", ~leak),
        (carrier & ok("B1") & ~probe, "carrier_loss", frozen & ~leak), (carrier & probe, "reader_miss", frozen & ~leak), (hit, "stale_conflict", ~vacuous & ~leak), (F.coalesce(default, F.lit(False)), "ok", ~leak),
    ]
    label, sure = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for cond, name, confident in reversed(rules):
        label, sure = F.when(cond, name).otherwise(F.coalesce(label, F.lit("ambiguous"))), F.when(cond, confident).otherwise(F.coalesce(sure, F.lit(False)))
    return p.select("item_id", label.alias("label"), sure.alias("confident"))


# --- statistics ------------------------------------------------------------------------------------------------------------


def mcnemar_p(b: int, c: int) -> float:
    """Two-sided exact binomial p of discordant pairs, by logarithms, so that any counts do."""
    n = b + c
    if n == 0:
        return 1.0
    terms = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * log(2) for i in range(max(0, min(b, c) - 40 * int(n**0.5 + 1)), min(b, c) + 1)]
    top = max(terms)
    return min(1.0, 2 * exp(top) * sum(exp(t - top) for t in terms))


def mcnemar(pairs: DataFrame) -> DataFrame:
    """One row (b, c, p) of paired correctness flags a and b; the counts are aggregated before the test."""
    n = pairs.agg(F.count_if(F.col("a") & ~F.col("b")).alias("b"), F.count_if(~F.col("a") & F.col("b")).alias("c"))
    return n.mapInPandas(lambda it: (d.assign(p=[round(mcnemar_p(int(x), int(y)), 6) for x, y in zip(d["b"], d["c"])]) for d in it), "b long, c long, p double")


class Clusters:
    """Sums and counts of paired differences by cluster, and the wild cluster bootstrap-t over them."""

    def __init__(self, sums, counts, seed: int = 1234):
        self.s, self.n = np.asarray(sums, dtype=float), np.asarray(counts, dtype=float)
        self.g, self.total = len(self.s), float(np.sum(counts))
        self.delta = float(self.s.sum() / self.total) if self.total else float("nan")
        self.seed = seed
        self.se = self._se(self.s - self.n * self.delta) if self.g > 1 else 0.0

    def _se(self, resid: np.ndarray) -> float:
        return float(np.sqrt(self.g / (self.g - 1) * (resid**2).sum()) / self.total)

    def signs(self) -> Iterator[np.ndarray]:
        """All sign vectors of up to 16 clusters, else random ones, in blocks of bounded size."""
        if self.g <= SIGNS_EXACT:
            yield np.array(list(product((-1.0, 1.0), repeat=self.g)))
            return
        rng, step = np.random.default_rng(self.seed), max(1, 4_000_000 // self.g)
        for a in range(0, SIGNS, step):
            yield rng.choice([-1.0, 1.0], size=(min(step, SIGNS - a), self.g))

    def p(self, at: float = 0.0) -> float:
        """p of the null that the difference is ``at``; 1 or 0 where no cluster differs from it."""
        a = self.s - self.n * at
        same = abs(self.delta - at) < 1e-12
        t0 = abs(self.delta - at) / self.se if self.se > 0 else 0.0 if same else np.inf
        above = count = 0
        for signs in self.signs():
            m = signs @ a / self.total
            e = np.sqrt(self.g / (self.g - 1) * ((signs * a - np.outer(m, self.n)) ** 2).sum(1)) / self.total
            ok = e > 0
            above += int((np.abs(m[ok]) / e[ok] >= t0 - 1e-12).sum())
            count += int(ok.sum())
        return above / count if count else 1.0 if same else 0.0

    def interval(self, points: int = 241, width: float = 6.0) -> tuple[float, float]:
        """All differences that the test does not reject, on a grid around the estimate that holds it and 0."""
        if not self.se > 0:
            return self.delta, self.delta
        grid = sorted({*np.linspace(self.delta - width * self.se, self.delta + width * self.se, points).tolist(), 0.0, self.delta})
        kept = [d for d in grid if self.p(d) > ALPHA]
        return (min(kept), max(kept)) if kept else (self.delta, self.delta)

    def percentile_interval(self) -> tuple[float, float]:
        """Resampled clusters, for comparison."""
        rng, means = np.random.default_rng(self.seed), []
        for _ in range(DRAWS):
            i = rng.integers(0, self.g, self.g)
            if self.n[i].sum():
                means.append(self.s[i].sum() / self.n[i].sum())
        means.sort()
        return (means[int(ALPHA / 2 * len(means))], means[int((1 - ALPHA / 2) * len(means)) - 1]) if means else (float("nan"), float("nan"))


CONTRAST = "n long, clusters long, delta double, se double, p double, low double, high double, informative long, p_floor double, decidable boolean, pct_low double, pct_high double"


def contrast(diffs: DataFrame, cluster: str = "cluster", value: str = "diff", intervals: bool = True) -> DataFrame:
    """One row of ``CONTRAST``: the mean paired difference with the wild cluster bootstrap-t over (cluster, diff) rows.

    ``p_floor`` is the least p that so many informative clusters can give; above 0.05 nothing can be decided. Fewer than two
    clusters give nulls. Differences are summed by cluster first; only sums reach the one task of the test.
    """
    sums = diffs.filter(F.col(value).isNotNull()).groupBy(cluster).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count("*").alias("n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        d = pd.concat(parts).sort_values(cluster) if parts else pd.DataFrame({"s": [], "n": [], cluster: []})
        c = Clusters(d["s"].to_numpy(), d["n"].to_numpy())
        k = int((c.s != 0).sum())
        floor = 1.0 if k < 1 else 2.0 ** (1 - k)
        row = [int(c.total), c.g, *[None] * 5, k, floor, bool(floor <= ALPHA), None, None]
        if c.g > 1:
            low, high = c.interval() if intervals and c.g <= SIGNS_EXACT else (None, None)
            row[2:7] = [round(c.delta, 6), round(c.se, 6), round(c.p(), 6), low if low is None else round(low, 6), high if high is None else round(high, 6)]
            row[10:] = [round(x, 6) for x in c.percentile_interval()]
        if parts:
            yield pd.DataFrame([row], columns=[x.split()[0] for x in CONTRAST.split(", ")])

    return sums.coalesce(1).mapInPandas(run, CONTRAST)


def wild_cluster(sums: list[tuple[float, int]]) -> dict[str, float]:
    """Wild cluster bootstrap-t of a mean difference from (sum, count) of clusters."""
    c = Clusters([x for x, _ in sums], [n for _, n in sums])
    return {"delta": round(c.delta, 6), "p": round(c.p(), 6)} if c.g > 1 else {"delta": float("nan"), "p": float("nan")}


def bootstrap(diffs: DataFrame, cluster: str = "cluster", value: str = "diff", draws: int = DRAWS, seed: int = 1234) -> DataFrame:
    """One row (delta, low, high, p): the mean difference, the interval of resampled clusters, and the two-sided share of
    resamples on the other side of 0. With items as clusters it is the plain bootstrap. Sums by cluster go to one task."""
    sums = diffs.filter(F.col(value).isNotNull()).groupBy(cluster).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count("*").alias("n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        d = pd.concat(parts).sort_values(cluster)
        s, n, rng = d["s"].to_numpy(), d["n"].to_numpy(dtype=float), np.random.default_rng(seed)
        means = np.empty(draws)
        for i in range(draws):
            w = rng.multinomial(len(s), np.full(len(s), 1 / len(s)))  # how often each cluster is drawn
            means[i] = (w * s).sum() / (w * n).sum()
        means.sort()
        p = min(1.0, 2 * min((means <= 0).mean(), (means >= 0).mean()))
        yield pd.DataFrame([[round(float(s.sum() / n.sum()), 6), round(float(means[int(ALPHA / 2 * draws)]), 6), round(float(means[int((1 - ALPHA / 2) * draws) - 1]), 6), round(float(p), 6)]], columns=["delta", "low", "high", "p"])

    return sums.coalesce(1).mapInPandas(run, "delta double, low double, high double, p double")


def arm_summary(reads: DataFrame) -> DataFrame:
    """Accuracy by arm and the gains between arms on the items that both ran: (n_items, a1, a2, a3, gain_closure, loss_router,
    loss_closure). ``reads``: item_id, arm (A1 seeds, A2 with closure, A3 given seeds, A4 gold), correct."""
    p = reads.groupBy("item_id").pivot("arm", ["A1", "A2", "A3", "A4"]).agg(F.max(F.col("correct").cast("int")))
    gap = lambda x, y: round6(F.avg(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.col(x) - F.col(y))))
    return p.agg(F.count("*").alias("n_items"), *[round6(F.avg(a)).alias(a.lower()) for a in ("A1", "A2", "A3")], gap("A2", "A1").alias("gain_closure"), gap("A3", "A2").alias("loss_router"), gap("A4", "A3").alias("loss_closure"))


def positive_control(scores: DataFrame, truth: DataFrame, m: int = 3) -> DataFrame:
    """(n, hit, rank): how often the true parent is among the m best, and its mean rank. ``scores``: id, parent, score; ``truth``: id, parent."""
    r = scores.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), F.desc("parent"))))
    d = truth.join(r.select("id", "parent", "r"), ["id", "parent"], "left")
    return d.agg(F.count("*").alias("n"), round6(F.avg(F.coalesce((F.col("r") <= m).cast("int"), F.lit(0)))).alias("hit"), round6(F.avg("r")).alias("rank"))


def leak_guard(rows: DataFrame) -> DataFrame:
    """Accuracy of packets that hold carriers alone. ``rows``: correct, n_sources, n_carriers."""
    return rows.filter("n_sources = 0 and n_carriers > 0").agg(round6(F.avg(F.col("correct").cast("int"))).alias("accuracy"), F.count("*").alias("n"))


def flip_rates(pairs: DataFrame) -> DataFrame:
    """Shares of items whose correctness changes from a to b: any way, lost, won; and of those right in a that stay right."""
    a, b = F.col("a"), F.col("b")
    mean = lambda c: round6(F.avg(c.cast("int")))
    return pairs.agg(mean(a != b).alias("flipped"), mean(a & ~b).alias("lost"), mean(~a & b).alias("won"), mean(F.when(a, b)).alias("kept"), F.count("*").alias("n"))


def perfect_reader(context: Column, gold: Column) -> Column:
    """What a perfect reader answers: right iff the gold value stands in the context."""
    return F.coalesce(T.contains_value(context, gold), F.lit(False))
