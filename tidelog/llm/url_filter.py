"""Verdicts on URLs: rules for hosts and paths first, a logistic model for the rest."""

from __future__ import annotations

import csv
import zlib
from collections.abc import Sequence
from pathlib import Path
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import sigmoid

BUCKETS = 1 << 14
GRAMS = (3, 4, 5)
LABELLED = Path(__file__).with_name("labelled_urls.csv")
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path; both empty for null and for URLs without `://`."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _CAPITALS, _SMALL), path


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule (host, path, verdict) that fits, as struct(size, rule, verdict), or null.

    A rule fits its host and every subdomain if the path starts with the rule's path. Equal
    lengths are settled by the rule's text.
    """
    fits = []
    for name, start, verdict in rules:
        on_host = (host == name) | host.endswith("." + name)
        value = F.struct(
            F.lit(len(name + start)).alias("size"),
            F.lit(name + start).alias("rule"),
            F.lit(verdict).alias("verdict"),
        )
        fits.append(F.when(on_host & path.startswith(start), value))
    return F.array_max(F.array_compact(F.array(*fits)))


def url_grams(host: str, path: str) -> np.ndarray:
    """Distinct buckets of the character n-grams of host and path, each in its own space."""
    found = set()
    for kind, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in GRAMS:
            for at in range(len(text) - n + 1):
                found.add(zlib.crc32((kind + text[at : at + n]).encode("utf-8", "surrogatepass")) % BUCKETS)
    return np.fromiter(found, dtype=np.int64, count=len(found))


def fit_url_model(rows: Sequence[tuple[str, str, int]], passes: int = 30, penalty: float = 1e-4):
    """Weights of P(block) from labelled (host, path, 1 = block); the last is the intercept.

    Adaptive gradient steps over the whole table in a fixed order. Without both classes there
    is nothing to learn and every URL gets the known share.
    """
    weights = np.zeros(BUCKETS + 1)
    share = (sum(y for *_, y in rows) + 0.5) / (len(rows) + 1.0)
    weights[-1] = np.log(share / (1 - share))
    if len({y for *_, y in rows}) < 2:
        return weights
    features = [(np.append(url_grams(h, p), BUCKETS), y) for h, p, y in rows]
    squares = np.full(BUCKETS + 1, 1e-8)
    order = np.random.default_rng(7)
    for _ in range(passes):
        for k in order.permutation(len(features)):
            at, y = features[k]
            scale = 1.0 / np.sqrt(len(at))
            gradient = (sigmoid(weights[at].sum() * scale) - y) * scale + penalty * weights[at]
            squares[at] += gradient * gradient
            weights[at] -= 0.3 * gradient / np.sqrt(squares[at])
    return weights


def block_probability(weights: np.ndarray, hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
    out = np.empty(len(hosts))
    for k, (host, path) in enumerate(zip(hosts, paths)):
        at = np.append(url_grams(host, path), BUCKETS)
        out[k] = weights[at].sum() / np.sqrt(len(at))
    return sigmoid(out)


def labelled_table(path: Path = LABELLED) -> list[tuple[str, str, int]]:
    """Rows (host, path, 1 = block) of a file with the columns url and label.

    `labelled_urls.csv` is written by hand: 225 host names labelled by what they say, with four
    URLs each. Every top-level domain and language folder has the same share of bad hosts, so
    neither says anything about the label; no rule was asked, and no host is one of the pages'.
    """
    with open(path, encoding="utf-8", newline="") as file:
        rows = [(urlsplit(r["url"]), int(r["label"])) for r in csv.DictReader(file)]
    return [(url.netloc.lower(), url.path, label) for url, label in rows]


def labelled_by_rules(pages: DataFrame, rules: Sequence[tuple[str, str, str]], rows: int) -> list[tuple]:
    """At most `rows` distinct URLs of either verdict that rules judge, labelled by the verdict.

    Chosen by a hash of host and path, so the same pages give the same table.
    """
    host, path = host_and_path(F.col("url"))
    known = pages.select(host.alias("host"), path.alias("path"))
    known = known.withColumn("fit", matching_rule(F.col("host"), F.col("path"), rules))
    known = known.where("fit is not null").select("host", "path", F.col("fit.verdict").alias("verdict"))
    out: list[tuple] = []
    for verdict, label in (("allow", 0), ("block", 1)):
        part = known.where(F.col("verdict") == verdict).distinct()
        part = part.orderBy(F.xxhash64("host", "path"), "host", "path").limit(rows)
        out += [(r.host, r.path, label) for r in part.select("host", "path").collect()]
    return out


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]], labelled: Sequence[tuple[str, str, int]]
) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every page.

    `rule` is the fitting rule or null; `score` is P(block) of the model; `verdict` is the
    rule's, else block from a score of 0.5 on. A null URL has empty host and path and is judged
    like any other; a null page_id is kept; repeated rows are judged each.
    """
    host, path = host_and_path(F.col("url"))
    base = pages.select("page_id", host.alias("host"), path.alias("path"))
    weights = fit_url_model(labelled)

    def score(host: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series(block_probability(weights, host.tolist(), path.tolist()))

    scored = base.withColumn("score", F.pandas_udf(score, "double")("host", "path"))
    fit = matching_rule(F.col("host"), F.col("path"), rules)
    return scored.withColumn("_fit", fit).select(
        "page_id",
        "host",
        "path",
        F.col("_fit.rule").alias("rule"),
        F.coalesce("_fit.verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"),
        "score",
    )
