"""Quality: a sparse rule ensemble over text statistics, compiled to Spark column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockyard.llm.common import words
from blockyard.session import materialize

#: Character classes whose share of a text is a statistic.
CLASSES = {"letters": r"\p{L}", "capitals": r"\p{Lu}", "digits": r"\p{Nd}", "stops": r".,;:!?", "symbols": r"\p{S}#%&*@/\\_{}\[\]"}
STATISTICS = ["chars", "words", "word_length", "longest_word", "distinct_words", "repeated_words", "wordless", "lines",
              "distinct_lines", "closed_lines", *CLASSES]


@dataclass(frozen=True)
class Options:
    """What is learned from at most (rows per label; counts and scores cover all rows), and the shape of the ensemble."""
    rows_per_label: int = 4000
    trees: int = 40
    depth: int = 3
    bins: int = 48
    shrink: float = 0.3
    sample: float = 0.6
    support: float = 0.004
    steps: int = 250
    seed: int = 5


def _crc(key: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8"))


def held_out(key: Column) -> Column:
    """Rows that are never learned from: crc32 of the key as text, modulo 5, is 0."""
    return _crc(key) % 5 == 0


def tuning(key: Column) -> Column:
    """One learning row in eight chooses the strength of the lasso and is not fitted."""
    return F.floor(_crc(key) / 5) % 8 == 0


def statistics(text: Column) -> Column:
    """Struct of STATISTICS, all doubles; shares are 0 where there is nothing to share, so null and empty texts have
    zeros throughout."""
    t = F.coalesce(text, F.lit(""))
    parts = F.struct(t.alias("t"), words(t).alias("w"), F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "").alias("l"))

    def made(p):
        t, w, lines = p["t"], p["w"], p["l"]
        share = lambda n, of: F.when(of > 0, n / of).otherwise(F.lit(0.0))
        n, k, m = F.length(t), F.size(w), F.size(lines)
        found = {
            "chars": n, "words": k, "lines": m,
            "word_length": share(F.length(F.array_join(w, "")), k),
            "longest_word": F.coalesce(F.array_max(F.transform(w, F.length)), F.lit(0)),
            "distinct_words": share(F.size(F.array_distinct(w)), k),
            "repeated_words": share(F.size(F.filter(w, lambda x, i: (i > 0) & (x == F.get(w, i - 1)))), k),
            "wordless": share(F.size(F.filter(w, lambda x: ~x.rlike(r"\p{L}"))), k),
            "distinct_lines": share(F.size(F.array_distinct(lines)), m),
            "closed_lines": share(F.size(F.filter(lines, lambda x: x.rlike(r"[.!?:;\"'…。]\s*$"))), m),
        } | {name: share(F.length(F.regexp_replace(t, f"[^{kind}]+", "")), n) for name, kind in CLASSES.items()}
        return F.struct(*[found[s].cast("double").alias(s) for s in STATISTICS])
    return F.transform(F.array(parts), made)[0]  # the parts are made once


#: A rule: (statistic, lowest (excluded), highest (included)) per statistic, all of which must hold.
Rule = tuple[tuple[str, float, float], ...]


@dataclass(frozen=True)
class RuleModel:
    """score = sigmoid(intercept + sum of the weights of the rules that hold)."""
    intercept: float
    rules: tuple[tuple[float, Rule], ...]

    def column(self, value=F.col) -> Column:
        """The score as a Spark expression over columns named like the statistics."""
        total = F.lit(float(self.intercept))
        for weight, rule in self.rules:
            holds = F.lit(True)
            for name, low, high in rule:
                if low > -np.inf:
                    holds = holds & (value(name) > float(low))
                if high < np.inf:
                    holds = holds & (value(name) <= float(high))
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def holds(self, x: np.ndarray) -> np.ndarray:
        """Rows x rules, for rows of statistics in the order of STATISTICS."""
        return rule_matrix(x, [r for _, r in self.rules])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.intercept + self.holds(x) @ np.array([w for w, _ in self.rules]))))

    def describe(self) -> list[str]:
        """The rules as text, the heaviest first."""
        def part(name, low, high):
            return " < ".join(([f"{low:.4g}"] if low > -np.inf else []) + [name]) + (f" <= {high:.4g}" if high < np.inf else "")
        return [f"{w:+.3f}  " + " and ".join(part(*c) for c in r) for w, r in sorted(self.rules, key=lambda x: -abs(x[0]))]


def rule_matrix(x: np.ndarray, rules: Sequence[Rule]) -> np.ndarray:
    out = np.ones((len(x), len(rules)), np.float64)
    at = {s: i for i, s in enumerate(STATISTICS)}
    for j, rule in enumerate(rules):
        for name, low, high in rule:
            out[:, j] *= (x[:, at[name]] > low) & (x[:, at[name]] <= high)
    return out


def _grow(binned, edges, grad, hess, rows, depth, box, rules, update, o: Options) -> None:
    """Splits `rows` where the second-order gain is largest and goes on with both sides; each side's path is a rule."""
    best = (1e-6, None)
    if depth:
        g_all, h_all = grad[rows].sum(), hess[rows].sum()
        for f in range(binned.shape[1]):
            b = binned[rows, f]
            g = np.bincount(b, grad[rows], o.bins + 1).cumsum()[:-1]
            h = np.bincount(b, hess[rows], o.bins + 1).cumsum()[:-1]
            n = np.bincount(b, minlength=o.bins + 1).cumsum()[:-1]
            gain = g * g / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1) - g_all * g_all / (h_all + 1)
            gain[(n == 0) | (n == len(rows))] = 0
            gain[len(edges[f]):] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (f, k))
    if best[1] is None:
        update[rows] = -o.shrink * grad[rows].sum() / (hess[rows].sum() + 1)
        return
    f, k = best[1]
    left = binned[rows, f] <= k
    name, cut = STATISTICS[f], float(edges[f][k])
    for side, low, high in ((rows[left], -np.inf, cut), (rows[~left], cut, np.inf)):
        old = box.get(name, (-np.inf, np.inf))
        inner = box | {name: (max(low, old[0]), min(high, old[1]))}
        rules.add(tuple((s, *inner[s]) for s in sorted(inner)))
        _grow(binned, edges, grad, hess, side, depth - 1, inner, rules, update, o)


def tree_rules(x: np.ndarray, y: np.ndarray, o: Options) -> list[Rule]:
    """The paths of boosted shallow trees, each grown on a part of the rows, as rules of some support."""
    r = np.random.default_rng(o.seed)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, o.bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    margin, rules = np.zeros(len(x)), set()
    for _ in range(o.trees):
        p = 1 / (1 + np.exp(-margin))
        rows = np.sort(r.choice(len(x), max(1, int(o.sample * len(x))), replace=False))
        update = np.zeros(len(x))
        _grow(binned, edges, p - y, p * (1 - p), rows, o.depth, {}, rules, update, o)
        margin += update
    rules = sorted(rules)
    share = rule_matrix(x, rules).mean(axis=0) if rules else np.array([])
    return [rule for rule, s in zip(rules, share) if o.support <= s <= 1 - o.support]


def lasso_logistic(a: np.ndarray, y: np.ndarray, strength: float, steps: int, start: np.ndarray | None = None) -> np.ndarray:
    """Weights (the intercept, unpenalised, first) that minimise mean log loss + strength * sum |w|: accelerated
    proximal gradient with restarts."""
    a = np.hstack([np.ones((len(a), 1)), a])
    w = np.zeros(a.shape[1]) if start is None else start.copy()
    step = 4 * len(a) / max(np.linalg.norm(a, 2) ** 2, 1e-9)
    v, t = w.copy(), 1.0
    for _ in range(steps):
        grad = a.T @ (1 / (1 + np.exp(-(a @ v))) - y) / len(a)
        new = v - step * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * strength, 0)
        if ((v - new) * (new - w)).sum() > 0:
            t = 1.0
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / nt * (new - w), new, nt
    return w


def log_loss(p: np.ndarray, y: np.ndarray) -> float:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()) if len(y) else 0.0


def fit_rules(x: np.ndarray, y: np.ndarray, tune_x: np.ndarray, tune_y: np.ndarray, o: Options = Options()) -> RuleModel:
    """Rules from trees on (x, y), their weights by lasso, its strength the best on the tuning rows (without any: the
    fourth of the path). Label 0 or 1; one label alone gives a constant score."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    rules = tree_rules(x, y, o) if 0 < y.mean() < 1 else []
    if not rules:
        return RuleModel(float(np.log(share / (1 - share))), ())
    a, b = rule_matrix(x, rules), rule_matrix(tune_x, rules)
    most = np.abs(a.T @ (y - y.mean())).max() / len(y)
    best, w = None, None
    for k in range(1, 9):
        w = lasso_logistic(a, y, most * 0.45 ** k, o.steps, w)
        loss = log_loss(1 / (1 + np.exp(-(w[0] + b @ w[1:]))), tune_y) if len(tune_y) else abs(k - 4)
        if best is None or loss < best[0]:
            best = (loss, w)
    w = best[1]
    return RuleModel(float(w[0]), tuple((float(c), r) for c, r in zip(w[1:], rules) if abs(c) > 1e-6))


def fit(stats: DataFrame, labels: DataFrame, key: str, label: str, options: Options) -> RuleModel | None:
    """A model from at most rows_per_label learning rows of each label, the first in a pseudo-random order of the keys;
    None without learning rows. stats: `_k` and the statistics. Of rows with one key, the one with the least statistics
    is learned from, so the rows that are collected are bounded by the options."""
    usable = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key))) \
        .groupBy(key).agg(F.min(label).cast("int").alias("_y")).withColumn("_h", F.xxhash64(key))
    usable = materialize(usable, "quality-labels")
    counts = {r["_y"]: r["n"] for r in usable.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    some = [usable.where(F.col("_y") == y).orderBy("_h", key).limit(options.rows_per_label) for y in (0, 1)]
    some = materialize(some[0].unionByName(some[1]).select(F.col(key).alias("_key"), "_y"), "quality-sample")
    rows = stats.join(some, F.col("_k") == F.col("_key")).groupBy("_key", "_y") \
        .agg(F.min(F.struct(*STATISTICS)).alias("s")).select("_key", "_y", tuning(F.col("_key")).alias("_tune"), "s.*")
    got = rows.toArrow().sort_by([("_key", "ascending")])
    x = np.stack([got[s].to_numpy() for s in STATISTICS], axis=1) if got.num_rows else np.zeros((0, len(STATISTICS)))
    y, tune = got["_y"].to_numpy().astype(float), got["_tune"].to_numpy().astype(bool)
    if not (~tune).any():
        return None
    model = fit_rules(x[~tune], y[~tune], x[tune], y[tune], options)
    # the sample may be denser in one label than the learning rows are: scores are set back to these rows' share
    if 0 < y.mean() < 1:
        all_, sampled = counts[1] / (counts[0] + counts[1]), float(y.mean())
        model = RuleModel(model.intercept + float(np.log(all_ / (1 - all_)) - np.log(sampled / (1 - sampled))), model.rules)
    return model


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
            at: float = 0.3, options: Options = Options()) -> DataFrame:
    """One row per row of docs: its key (as `doc_id`), held_out, score and predicted (1 where score >= at).

    Statistics come from whole texts, in one pass over the documents, and are written as a narrow table, from which the
    model is fitted and all rows are scored by one expression per rule. Null, empty and wordless texts have statistics
    of zero and are scored like any other. Rows with a null key are scored, never learned from and not held out unless
    crc32 of the empty text is. Repeated rows each give a row. Repeated labels count as 1 only if all of them do; null
    and other labels are passed over. Without learning rows all scores are 0.5; with one label alone they are constant.
    An empty table gives no rows. Labels, language, source and key never enter a score; other columns are not read."""
    stats = docs.select(docs[key].alias("_k"), statistics(docs[text]).alias("s")).select("_k", "s.*")
    stats = materialize(stats, "quality-statistics")
    model = fit(stats, labels, key, label, options)
    score = model.column() if model else F.lit(0.5)
    return stats.select("_k", score.alias("score")).select(
        F.col("_k").alias("doc_id"), held_out(F.col("_k")).alias("held_out"), "score",
        (F.col("score") >= at).cast("int").alias("predicted"))
