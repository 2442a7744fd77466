"""URL filters: rules first, then gradient-boosted trees on lexical features.

Rules name a host (and its subdomains) and a path prefix; the longest that fits decides. Other urls are judged by
boosted regression trees (logistic loss, histogram splits) over lexical features: lengths, depth, digit ratio, entropy,
parameter counts, and how often urls with the same suffix (last host label, last two) are blocked. The trees are trained
here from labelled urls, a sample whose bound is a parameter; suffix statistics cover all labelled urls, in a fixed
number of hashed buckets.

Scale: one narrow pass over the urls, which ships the trees and the bucket rates, both of fixed size. Labels are counted
by partial sums; nothing else is shuffled.

Defined results: a null url, or one without `://`, has an empty host and path and is judged by the trees on its text; rules of
equal length are taken by action, host, path; without labels of both kinds the trees allow everything; equal urls are
judged alike; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
BUCKETS = 512
FEATURES = ["length", "host_length", "host_labels", "longest_label", "hyphens", "depth", "path_length", "digit_ratio", "parameters", "query_length", "fragment_length", "encoded", "entropy", "host_entropy", "rate_last", "rate_last_two"]
#: Shares of the labelled urls, by a hash; a url of one learns with the suffix rates of the others.
FOLDS = 4
Rule = tuple[str, str, str]  # action, host, path


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0)
    path = F.regexp_extract(F.coalesce(F.substring(rest, F.length(host) + 1, F.length(url)), F.lit("")), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def ruled(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule's text and action, or nulls. Rules are few: they become one chain of conditions."""
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r), reverse=False):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text, action = F.when(fits, rule_host + rule_path).otherwise(text), F.when(fits, kind).otherwise(action)
    return text, action


def _entropy(text: str) -> float:
    if not text:
        return 0.0
    n = np.array([text.count(c) for c in set(text)]) / len(text)
    return float(-(n * np.log2(n)).sum())


def _count(text: Column, part: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))


def _filled(text: Column, sign: str) -> Column:
    """The number of non-empty parts between signs."""
    return F.size(F.filter(F.split(text, sign), lambda x: x != ""))


def lexical(url: Column, host: Column, path: Column) -> Column:
    """FEATURES as an array, but for the entropies and rates, which come behind."""
    url = F.coalesce(url, F.lit(""))
    before = F.substring_index(url, "#", 1)
    query = F.when(F.instr(before, "?") > 0, F.substring(before, F.instr(before, "?") + 1, F.length(before))).otherwise("")
    labels = F.split(host, "[.]")
    fragment = F.greatest(F.length(url) - F.length(before) - 1, F.lit(0))
    digits = F.regexp_count(url, F.lit("[0-9]")) / F.greatest(F.length(url), F.lit(1))
    values = [F.length(url), F.length(host), F.size(labels), F.array_max(F.transform(labels, F.length)), _count(host, "-"), _filled(path, "/"), F.length(path), digits, _filled(query, "&"), F.length(query), fragment, _count(url, "%")]
    return F.array(*[v.cast("double") for v in values])


def suffix_buckets(host: Column) -> Column:
    """Buckets of the host's last label and of its last two."""
    return F.array(*[F.pmod(F.crc32(F.substring_index(host, ".", -k).cast("binary")), F.lit(BUCKETS)).cast("int") for k in (1, 2)])


def features(urls: list[str | None], hosts: list[str], lexical_values: np.ndarray, buckets: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each url. rates: of each bucket, or of each url's fold and bucket."""
    entropies = [[_entropy(u or ""), _entropy(h)] for u, h in zip(urls, hosts, strict=True)]
    own = rates if rates.ndim == 3 else np.broadcast_to(rates, (len(urls), *rates.shape))
    at = np.arange(len(urls))
    return np.column_stack([lexical_values, np.array(entropies).reshape(len(urls), 2), own[at, 0, buckets[:, 0]], own[at, 1, buckets[:, 1]]])


@dataclass
class Trees:
    """Complete trees of one depth: a feature and a limit for each inner node, a value for each leaf."""

    base: float = -20.0
    features: list[np.ndarray] = field(default_factory=list)
    limits: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, limit, leaf in zip(self.features, self.limits, self.leaves, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while (node < len(f)).any():
                node = 2 * node + 1 + (x[np.arange(len(x)), f[node]] > limit[node])
            total += leaf[node - len(f)]
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def boost(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0) -> Trees:
    """Newton boosting with histogram splits."""
    if not len(y) or y.min() == y.max():
        return Trees(base=20.0 if len(y) and y.min() == 1 else -20.0)
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T, strict=True)], axis=1)
    model = Trees(base=float(np.log(y.mean() / (1 - y.mean()))))
    total = np.full(len(y), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        split_on, limit = np.zeros((1 << depth) - 1, dtype=np.int64), np.full((1 << depth) - 1, np.inf)
        for level in range(depth):
            start, n = (1 << level) - 1, 1 << level
            best = np.full(n, 1e-9)
            cut_at = np.zeros(n, dtype=np.int64)
            for f in range(x.shape[1]):
                if not len(edges[f]):
                    continue
                at = (node - start) * (bins + 1) + binned[:, f]
                gs, hs = (np.bincount(at, weights=v, minlength=n * (bins + 1)).reshape(n, -1).cumsum(axis=1) for v in (g, h))
                gain = gs**2 / (hs + l2) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + l2) - gs[:, -1:] ** 2 / (hs[:, -1:] + l2)
                gain = gain[:, : len(edges[f])]
                top = gain.argmax(axis=1)
                better = gain[np.arange(n), top] > best + 1e-12
                best = np.where(better, gain[np.arange(n), top], best)
                split_on[start : start + n][better], cut_at[better] = f, top[better]
                limit[start : start + n][better] = edges[f][top[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), split_on[node]] > limit[node])
        at = node - ((1 << depth) - 1)
        leaf = -rate * np.bincount(at, weights=g, minlength=1 << depth) / (np.bincount(at, weights=h, minlength=1 << depth) + l2)
        total += leaf[at]
        model.features.append(split_on)
        model.limits.append(limit)
        model.leaves.append(leaf)
    return model


def fold(url: Column) -> Column:
    return F.pmod(F.xxhash64(url, F.lit("fold")), F.lit(FOLDS)).cast("int")


def suffix_rates(labelled: DataFrame, prior: float = 20.0) -> np.ndarray:
    """Smoothed rates of blocked urls by hashed suffix, over all labelled urls: for each fold those of the other folds, and at
    last those of all; each two rows of BUCKETS."""
    rows = labelled.select(F.posexplode(suffix_buckets(F.col("host"))).alias("k", "bucket"), fold(F.col("url")).alias("fold"), "y")
    seen, blocked = np.zeros((FOLDS + 1, 2, BUCKETS)), np.zeros((FOLDS + 1, 2, BUCKETS))
    for r in rows.groupBy("k", "bucket", "fold").agg(F.count("*").alias("n"), F.sum("y").alias("s")).collect():  # at most 8 x BUCKETS rows
        for out, v in ((seen, r.n), (blocked, r.s)):
            out[np.arange(FOLDS + 1) != r.fold, r.k, r.bucket] += v
    mean = blocked[:, :1].sum(axis=2, keepdims=True) / np.maximum(1, seen[:, :1].sum(axis=2, keepdims=True))
    return (blocked + prior * mean) / (seen + prior)


def fit(labelled: DataFrame, *, most: int = 8000) -> tuple[Trees, np.ndarray]:
    """labelled: url, host, path, y (1: block). Trees learn from at most `most` distinct urls, those with the least hashes."""
    rates = suffix_rates(labelled)
    distinct = labelled.where("url is not null").groupBy("url").agg(F.first("host").alias("host"), F.first("path").alias("path"), F.max("y").alias("y"))
    rows = distinct.orderBy(F.xxhash64("url"), "url").limit(most)
    rows = rows.select("url", "host", "y", fold(F.col("url")).alias("fold"), lexical(*map(F.col, ("url", "host", "path"))).alias("x"), suffix_buckets(F.col("host")).alias("buckets")).collect()
    x = features([r.url for r in rows], [r.host for r in rows], np.array([r.x for r in rows], dtype=float).reshape(len(rows), len(FEATURES) - 4), np.array([r.buckets for r in rows], dtype=int).reshape(len(rows), 2), rates[[r.fold for r in rows]])
    return boost(x, np.array([r.y for r in rows], dtype=float)), rates[FOLDS]


def judge(df: DataFrame, rules: list[Rule], model: Trees, rates: np.ndarray, *, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, score (of the trees)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = batch.column("x").flatten().to_numpy().reshape(n, len(FEATURES) - 4)
            buckets = batch.column("buckets").flatten().to_numpy().reshape(n, 2)
            scores = model.score(features(batch.column("url").to_pylist(), batch.column("host").to_pylist(), x, buckets, rates))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path", "rule", "action")), pa.array(np.round(scores, 6))], names=["page_id", "host", "path", "rule", "action", "score"])

    host, path = parts(F.col("url"))
    rows = df.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, action = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "url", "host", "path", rule.alias("rule"), action.alias("action"), lexical(*map(F.col, ("url", "host", "path"))).alias("x"), suffix_buckets(F.col("host")).alias("buckets"))
    out = rows.mapInArrow(run, "page_id long, host string, path string, rule string, action string, score double")
    verdict = F.coalesce("action", F.when(F.col("score") >= 0.5, BLOCK).otherwise(ALLOW))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def labelled_by_rules(df: DataFrame, rules: list[Rule], *, url_column: str = "url") -> DataFrame:
    """url, host, path, y of the urls that a rule decides."""
    host, path = parts(F.col("url"))
    rows = df.select(F.col(url_column).cast("string").alias("url")).select("url", host.alias("host"), path.alias("path"))
    return rows.select("*", ruled(F.col("host"), F.col("path"), rules)[1].alias("action")).where("action is not null").select("url", "host", "path", (F.col("action") == BLOCK).cast("int").alias("y"))
