"""Operator 4: URL filter by rules, then logistic regression on hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import ship_package

BUCKETS = 1 << 15
SIZES = (3, 4, 5)
#: A url is blocked on clear odds only: a wrong block loses a page, a wrong pass meets the later filters.
THRESHOLD = 0.6

# Labelled URLs that the model is trained on: block, then allow. None is a page of the given tables.
BLOCKED = """
www.cheap-meds.example.com/en/1 discount-pharmacy.example.net/es/261 pills-online.example.org/order
cheap-viagra.example.net/fr/44 diet-pills.example.com/en/903 generic-pills.example.org/de/18
casino-jackpot.example.org/en/14 www.casino-royal.example.com/slots bestcasino.example.net/es/72
win-big.example.com/jackpot online-poker.example.org/de/5 free-slots.example.net/spin
lucky-casino.example.com/en/410 casino-bonus.example.net/fr/33 you-win.example.org/en/612
spam-hub.example.org/links link-farm.example.com/en/9 seo-spam.example.net/backlinks
farm-links.example.org/es/128 spam-mail.example.com/en/350 content-farm.example.net/fr/81
adult-cams.example.com/live xxx-videos.example.net/en/650 hot-dating.example.org/singles
adult-only.example.org/de/31 xxx-adult.example.com/en/77 free-adult.example.net/gallery
porn-tube.example.com/video/12 sexy-chat.example.net/fr/208 nude-pics.example.org/gallery
payday-loans.example.com/apply fast-cash.example.net/en/54 get-rich.example.org/quick
crypto-double.example.com/invest free-bitcoin.example.net/claim forex-profit.example.org/es/90
replica-watches.example.com/rolex fake-bags.example.net/outlet cheap-shoes.example.org/en/732
miracle-diet.example.com/weight-loss lose-weight.example.net/fast keto-pills.example.org/trial
warez-zone.example.com/crack keygen-world.example.net/serial torrent-free.example.org/download
click-here.example.com/prize you-won.example.net/gift-card free-iphone.example.org/survey
ads-server.example.com/en/20 track-click.example.net/pixel ad-tracker.example.org/en/5 my-ads.example.net/banner
sports-bets.example.com/odds bet-tips.example.net/es/16 free-betting.example.org/en/31 bets-online.example.com/bonus
""".split()
ALLOWED = """
www.merando.example.org/en/12 blog.soltane.example.net/es/533 m.herbour.example.com/en/474.html
news.example.com/fr/2024/politics daily-times.example.net/article/311 science.example.org/physics
university.example.org/courses/math library.example.net/catalog museum.example.com/de/visit
recipes.example.com/en/bread gardening.example.net/roses travel-notes.example.org/es/madrid
docs.example.com/guide/install forum.example.net/thread/88 wiki.example.org/en/history
cityhall.example.net/services hospital.example.com/contact weather.example.org/today
football.example.com/results chess-club.example.net/games marathon.example.org/route
blog.landrie.example.net/fr/408 thorvin.example.net/en/770 anders.example.com/en/495
books.example.com/fr/roman poetry.example.net/de/gedicht music.example.org/en/concert
open-data.example.com/tables maps.example.net/region/7 history.example.org/es/siglo
blog.northen.example.net/en/455 www.methern.example.com/en/148.html hester.example.org/fr/414
kitchen.example.com/soup parents.example.net/school teachers.example.org/lesson
addresses.example.org/en/3 better-gardens.example.com/en/60 cheapside.example.net/history
freedom.example.com/essay winter.example.org/de/9 adultery-law.example.net/court/2
nations.example.net/en/61 m.stationery.example.org/fr/330 www.theses.example.com/es/12 blog.mathshop.example.net/en/9
editions.example.com/en/845 thistle.example.org/de/77 blog.fashion.example.com/fr/1204 north-shore.example.net/en/31
m.ration-book.example.org/es/450 themes.example.net/fr/66 www.together.example.com/en/5071 hearth.example.org/en/238
traditions.example.com/de/19 auctions.example.net/es/27 blog.athens.example.org/en/90 seventh-day.example.com/en/412
stone-age.example.org/fr/8 www.threads.example.net/de/640 anthem.example.com/es/333 erosion.example.net/en/118
thatcher.example.net/en/402 www.something.example.org/de/71 m.everything.example.com/es/5 growthstock.example.net/en/63
""".split()

# (host, path, verdict): the rules of the registered query.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty without ``://``. A-Z of the host are lower-cased."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                       "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def grams(hosts: Sequence[str], paths: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each character n-gram; host and path grams fall into different buckets."""
    rows, buckets = [], []
    for part, mark in ((hosts, b"h"), (paths, b"p")):
        texts = [b"^" + s.encode() + b"$" for s in part]
        data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        owner = np.repeat(np.arange(len(texts)), lengths)
        for size in SIZES:
            n = len(data) - size + 1
            if n <= 0:
                continue
            inside = owner[:n] == owner[size - 1:]
            h = np.full(n, size * 256 + mark[0], np.uint64)
            for j in range(size):
                h = (h ^ data[j:n + j]) * np.uint64(0x100000001B3)
                h ^= h >> np.uint64(29)
            rows.append(owner[:n][inside])
            buckets.append((h[inside] % np.uint64(BUCKETS)).astype(np.int64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(buckets)


def _signal(weights: np.ndarray, bias: float, rows: np.ndarray, buckets: np.ndarray, n: int) -> np.ndarray:
    count = np.maximum(np.bincount(rows, minlength=n), 1)
    return bias + np.bincount(rows, weights[buckets], n) / np.sqrt(count)


def train(urls: Sequence[tuple[str, str]], blocked: Sequence[int], rounds: int = 300, rate: float = 0.5,
          decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient descent on the labelled table."""
    rows, buckets = grams([h for h, _ in urls], [p for _, p in urls])
    n, y = len(urls), np.asarray(blocked, float)
    scale = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1))
    weights, bias = np.zeros(BUCKETS), 0.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-_signal(weights, bias, rows, buckets, n))) - y
        weights -= rate * (np.bincount(buckets, (error * scale)[rows], BUCKETS) + decay * weights)
        bias -= rate * error.mean()
    return weights, bias


def labelled() -> tuple[list[tuple[str, str]], list[int]]:
    cut = lambda s: (s[:s.index("/")], s[s.index("/"):])
    return [cut(s) for s in BLOCKED + ALLOWED], [1] * len(BLOCKED) + [0] * len(ALLOWED)


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD,
               table: tuple[list[tuple[str, str]], list[int]] | None = None,
               id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, p_block) of each row.

    A rule fits its host and all subdomains if the path starts with the rule's
    path; the longest rule wins (a block before an allow of equal length).
    Where none fits, the model decides: block from ``threshold`` on. A null
    url, or one without ``://``, has an empty host and path, fits no rule and
    is judged by the model like any other. A very long url is read whole.
    Repeated rows are judged each; an empty table gives no rows; other columns
    are not read. The model has a fixed size (``BUCKETS`` weights), so
    it travels with the task. Rules are part of the plan and so meant to be few.
    """
    ship_package(pages.sparkSession)
    weights, bias = train(*(table or labelled()))

    @F.pandas_udf("double")
    def p_block(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for host, path in parts:
            rows, buckets = grams(host.tolist(), path.tolist())
            yield pd.Series(1 / (1 + np.exp(-_signal(weights, bias, rows, buckets, len(host)))))

    host, path = url_parts(pages[url_column].cast("string"))
    parts = pages.select(pages[id_column].cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, ruling = F.lit(None).cast("string"), F.lit(None).cast("string")
    for on_host, on_path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[2] == "block")):
        fits = ((F.col("host") == on_host) | F.endswith(F.col("host"), F.lit("." + on_host))) \
            & F.startswith(F.col("path"), F.lit(on_path))
        rule = F.when(fits, on_host + on_path).otherwise(rule)
        ruling = F.when(fits, verdict).otherwise(ruling)
    return (parts.withColumn("p_block", p_block("host", "path"))
            .select("page_id", "host", "path", rule.alias("rule"),
                    F.coalesce(ruling, F.when(F.col("p_block") >= threshold, "block").otherwise("allow")).alias("verdict"),
                    "p_block"))
