"""URL filters: rules first, then logistic regression on hashed character n-grams.

A rule is a host and a path prefix; it covers the host and its subdomains, and
the longest fitting rule decides. URLs without a rule go to a classifier over
hashed character n-grams of host and path, trained from a small table of
labelled URLs. Scoring is row by row: nothing is shuffled, and a host with a
third of all pages is no special case.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, bounded_sample

BUCKETS = 1 << 16
SIZES = (3, 4, 5)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null without one.

    A rule is text such as ``example.net/en/``: host up to the first slash,
    the rest is the start of the path.
    """
    rule = F.lit(None).cast("string")
    verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


#: A small labelled URL table: names and page titles, unwanted and plain. A plain site with an unwanted page is
#: unwanted as well. Both classes stand under the same ends, folders and languages, so that only words tell them apart.
UNWANTED = (
    "casino-palace grandcasino casinos-online royal-poker pokerroom slots-heaven jackpot-city betting-tips livebets "
    "bets-and-odds discount-pills pillstore weightloss-pills viagra-shop cheapmeds rx-pharmacy spamhub bulk-spam spammers "
    "linkfarm backlink-farms adserver ads-network adstrack clicktracker popup-tracks adultclub adults-only xxxcams "
    "sexchat porntube escort-girls malware-kit warez-crack keygens payday-loans quickloan winbig win-prizes freespins "
    "free-money"
).split()
PLAIN = (
    "city-library university townnews garden-notes museum riverwatch cooking primary-school weather openmaps "
    "bike-repair history-journal math-forum translation traveldiary hospital code-docs birdsong parliament chessclub "
    "bookshop train-times choir sciencenews tree-notes wren stonehouse morning-post lake harbour northern teacher "
    "thinking either thereon notion windows-help address-book advice freedom-press smith-and-sons thornton motherwell "
    "fire-station education heritage brotherhood healthcare earthworks theatre thursday-market south-hill bathtubs "
    "another-day panther-fc leather-goods anthropology authors thames-boats mathews thistle southend threadneedle "
    "redhouse meadow-farm hillcrest bergmann dubois-fils garcia-hermanos green-acres kitchen-ideas photo-album "
    "school-news opening-times recipes contact team imprint products volunteers calendar statistics software-manual "
    "river-valley old-bakery woodwork field-notes brightwater parish-council physics-lab music-lessons toolmaker "
    "thatcher hatmaker chateau manhattan nathan than-you-think thanksgiving weekly-news family-tree constable tabletops "
    "stable-yard nations questions relation-studies mountain-rescue maintainers planner about-us whitby wheatfield "
    "southampton thousand-islands youth-club thunderstorm hand-crafts method mathtime timetable eighties cynthia "
    "acorn academy"
).split()
_ENDS = ("{}.com", "www.{}.org", "{}.net", "blog.{}.de", "m.{}.fr", "{}.co.uk", "shop.{}.info", "www.{}.es")
_FOLDERS = ("/", "/en/", "/de/", "/fr/articles/", "/es/", "/2019/04/", "/pages/", "/archive/17/")
_TAILS = ("", ".html", "/", "/3", "-2", ".php", "/index.html", "/about")


def small_table() -> list[tuple[str, str, bool]]:
    """The small labelled table as (host, path, block)."""
    urls = []
    for host_block, hosts in ((True, UNWANTED), (False, PLAIN)):
        for path_block, titles in ((True, UNWANTED), (False, PLAIN), (False, ("", "7", "12", "431"))):
            for i, host in enumerate(hosts):
                for k in range(12 if not host_block and not path_block else 3 - host_block):
                    at = 3 * i + 5 * k
                    title = titles[(7 * i + 11 * k + 3) % len(titles)]
                    path = _FOLDERS[(at + i // 8) % 8] + title + _TAILS[(at + 2 * k) % 8] if title else _FOLDERS[at % 8]
                    urls.append((_ENDS[(at + k) % 8].format(host), path, host_block or path_block))
    return urls


def buckets_of(host: str, path: str) -> np.ndarray:
    """Distinct hashed n-grams of host and of path, each part kept apart by its own start mark."""
    found = set()
    for part in ("h^" + host + "$", "p^" + path + "$"):
        mark, body = part[:1], part[1:]
        for n in SIZES:
            found.update(zlib.crc32((mark + body[i : i + n]).encode()) % BUCKETS for i in range(len(body) - n + 1))
    return np.fromiter(found, dtype=np.int64, count=len(found))


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, host: str, path: str) -> float:
        """Probability that the URL is to be blocked."""
        at = buckets_of(host, path)
        z = self.bias + float(self.weights[at].sum()) / max(1.0, np.sqrt(len(at)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(labelled: Sequence[tuple[str, str, bool]], epochs: int = 30, rate: float = 0.5, decay: float = 1e-4) -> Model:
    """Logistic regression by gradient steps over (host, path, block) rows.

    Both classes weigh the same. Without examples of both, every URL scores
    0.5 or the only class there is.
    """
    weights = np.zeros(BUCKETS)
    truth = np.array([float(b) for _, _, b in labelled])
    if not len(truth) or truth.min() == truth.max():
        return Model(weights, 0.0 if not len(truth) else (4.0 if truth[0] else -4.0))
    rows = [buckets_of(h, p) for h, p, _ in labelled]
    cost = np.where(truth > 0, 0.5 / truth.mean(), 0.5 / (1 - truth.mean()))
    bias, order = 0.0, np.random.default_rng(7)
    for epoch in range(epochs):
        step = rate / (1 + 0.2 * epoch)
        for i in order.permutation(len(rows)):
            scale = 1 / np.sqrt(max(1, len(rows[i])))
            z = bias + weights[rows[i]].sum() * scale
            slope = cost[i] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - truth[i])
            weights[rows[i]] -= step * (slope * scale + decay * weights[rows[i]])
            bias -= 0.1 * step * slope
    return Model(weights, bias)


def labelled_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url", rows: int = 2000) -> DataFrame:
    """A small labelled table: at most ``rows`` distinct URLs that a rule settles, chosen by hash."""
    host, path = host_and_path(F.col(f"`{url}`"))
    settled = (
        pages.select(F.col(f"`{url}`").alias("url"), host.alias("host"), path.alias("path"))
        .select("url", "host", "path", rule_for(F.col("host"), F.col("path"), rules)[1].alias("label"))
        .filter("label is not null")
        .distinct()
    )
    return bounded_sample(settled, rows, "url").select("host", "path", (F.col("label") == "block").alias("block"))


def judge(
    pages: DataFrame,
    labelled: DataFrame,
    rules: Sequence[tuple[str, str]],
    url: str = "url",
    threshold: float = 0.5,
) -> DataFrame:
    """Every row of ``pages`` with host, path, rule, verdict and score added.

    ``labelled`` (host, path, block) is small by contract and is read to the
    driver for training. Added columns are named ``url_host``, ``url_path``,
    ``url_rule``, ``url_verdict`` and ``url_score`` (replaced if they were
    there). Null URLs and URLs without ``://`` have empty host and path and
    go to the classifier like any other; repeated rows stay repeated; an empty
    table gives an empty one.
    """
    model = train([(r["host"] or "", r["path"] or "", bool(r["block"])) for r in labelled.collect()])
    weights, bias = model.weights, model.bias

    @F.pandas_udf("double")
    def scored(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        own = Model(weights, bias)
        for hosts, paths in parts:
            yield pd.Series([own.score(h, p) for h, p in zip(hosts, paths)], dtype=float)

    host, path = host_and_path(F.col(f"`{url}`"))
    rule, says = rule_for(F.col("url_host"), F.col("url_path"), rules)
    return (
        pages.withColumns({"url_host": host, "url_path": path})
        .withColumns({"url_rule": rule, "url_verdict": says, "url_score": scored("url_host", "url_path")})
        .withColumn(
            "url_verdict",
            F.coalesce("url_verdict", F.when(F.col("url_score") > threshold, "block").otherwise("allow")),
        )
    )
