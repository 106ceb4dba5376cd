"""URL filters: rules on host and path, and for all other URLs gradient-boosted trees over lexical features.

The trees are trained here in numpy, on binned features with the logistic loss, from labelled URLs. The tables at hand
label no URLs, so `seed` makes a labelled set: names of well-known sites and of well-known ad and tracking hosts, made-up
names of blocklists' words and of ordinary ones, random hosts and parameter spam. `learn` takes a labelled table instead.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: (host, path, verdict): the query's rules.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
WORDS = re.compile(r"[a-z]{3,}")
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
FEATURES = ("url_length", "host_length", "host_labels", "longest_label", "host_hyphens", "digit_ratio", "host_digits", "host_entropy", "path_length", "path_depth", "path_entropy", "parameters", "query_length", "escapes", "vowel_ratio", "suffix_rate", "suffix_seen", "gram_rate", "gram_rate_mean", "domain_rate")

#: Words of names on blocklists, by kind: gambling, drugs, adult, advertising, money, piracy.
_BAD = "poker roulette jackpot blackjack bingo slots lottery betting viagra cialis pharma meds steroid slimming xxx porn cams escort hookup adserver popunder affiliate clickbank tracker pixel banners loans payday forex credits crypto rewards prizes giveaway torrent keygen crack warez cheats replica followers".split()
_GOOD = "news library cityhall university gardening cooking museum weather sports science history docs wiki forum journal travel music school health photos archive radio market theatre community bakery hiking river garden society church clinic council academy press review kitchen studio village orchard".split()
#: Well-known ad and tracking hosts, and well-known sites.
_BAD_HOSTS = """doubleclick.net ad.doubleclick.net pagead2.googlesyndication.com pixel.quantserve.com b.scorecardresearch.com static.criteo.net
cdn.taboola.com widgets.outbrain.com ib.adnxs.com track.adform.net pixel.rubiconproject.com ads.pubmatic.com sync.openx.net match.adsrvr.org
c.amazon-adsystem.com cdn.popads.net serve.popcash.net syndication.exoclick.com s.adroll.com metrics.omtrdc.net counter.yadro.ru tags.bluekai.com
cm.everesttech.net securepubads.g.doubleclick.net bidr.trafficjunky.net pixel.mathtag.com ads.yieldmo.com banners.adfox.ru""".split()
_GOOD_HOSTS = """en.wikipedia.org github.com stackoverflow.com docs.python.org www.nytimes.com www.bbc.co.uk www.theguardian.com arxiv.org www.nature.com
www.gov.uk www.nasa.gov web.mit.edu www.stanford.edu www.reuters.com www.loc.gov www.who.int developer.mozilla.org www.w3.org pypi.org www.npmjs.com
www.debian.org www.kernel.org www.postgresql.org spark.apache.org www.eff.org www.gutenberg.org archive.org www.britannica.com www.un.org
www.lemonde.fr elpais.com www.spiegel.de www.zeit.de www.corriere.it www.etsy.com www.ikea.com www.imdb.com www.khanacademy.org
www.openstreetmap.org www.weather.gov www.metoffice.gov.uk mail.google.com www.amazon.com www.ox.ac.uk www.uni-heidelberg.de""".split()
_SUFFIXES = "com net org io info co.uk de fr es example.com example.net example.org example.edu".split()
_BAD_SUFFIXES = [*_SUFFIXES, "biz", "xyz", "top", "win", "click", "online", "site", "loan"]
_GOOD_SUFFIXES = [*_SUFFIXES, "edu", "gov", "eu", "museum", "ac.uk", "ch", "nl"]


def seed(rounds: int = 12) -> list[tuple[str, int]]:
    """(url, 1 if it is to be blocked). Both classes have plain paths, slugs, parameters and hyphenated hosts.

    No host, no hyphenated name and no path form (but a bare /) is taken from the tables the queries run on, so that
    figures on these aren't figures on the seed. Of the words of the tables' hyphenated names, ads and track occur as
    labels of well-known ad hosts, and win as a top-level domain.
    """
    rng = np.random.default_rng(5)
    pick = lambda some: str(some[int(rng.integers(len(some)))])
    paths = ["/", "/{w}", "/{w}/", "/{w}/{w}", "/{w}/{n}-{w}", "/{w}-{w}-{w}", "/{w}/{w}-{w}-{w}-{w}", "/{w}.php?id={n}", "/{w}?q={w}&sort={w}", "/search?q={w}&lang={w}&sort={w}", "/{w}?a={w}&b={n}&c={w}&d={w}", "/20{y}/{y}/{y}/{w}/{w}-{w}-{w}", "/{w}/{w}/{w}/{W}.{w}", "/{w}/{n}", "/{W}_{W}", "/{w}/{n}/{w}-{w}-{w}-{w}"]
    spam = ["/go.php?id={n}&aff={n}&sub={n}&clk={n}{n}", "/r/{n}{n}{n}/out?u=http%3A%2F%2F{w}", "/?k={n}&z={n}&v={n}{n}&q={w}+{w}+{w}"]
    serve = ["/{w}.gif?id={n}&cb={n}", "/js/{w}.js", "/sync?p={n}", "/imp?{w}={n}&r={n}{n}", "/{w};sz={n};ord={n}", "/{w}", "/{w}/{n}"]
    word = lambda: "".join(pick("bcdfgklmnprstv") + pick("aeiou") + ("" if rng.random() < 0.5 else pick("nrst")) for _ in range(rng.integers(1, 4)))
    fill = lambda p: re.sub(r"\{(.)\}", lambda m: {"y": str(rng.integers(10, 25)), "n": str(int(10 ** rng.uniform(0, 6.5))), "w": word(), "W": word().title()}[m[1]], p)
    front, scheme = lambda: pick(["", "", "www.", "www.", "shop."]), lambda: pick(["http", "https", "https"])
    out = []
    for _ in range(rounds):
        for bad, good in zip(_BAD, _GOOD):
            clean = [good, word() + word(), pick([f"{good}-{pick(_GOOD)}", f"{word()}-{good}", f"{word()}-{word()}", f"{good}-{word()}-{pick(_GOOD)}", f"{word()}{good}"])]
            foul = [pick([bad + pick(_BAD), f"{bad}-{word()}", f"{word()}-{bad}", f"{bad}{word()}"]), "-".join(pick(_BAD) for _ in range(rng.integers(2, 4)))]
            out += [(f"{scheme()}://{front()}{name}.{pick(_GOOD_SUFFIXES)}{fill(pick(paths))}", 0) for name in clean]
            out += [(f"{scheme()}://{front()}{name}.{pick(_BAD_SUFFIXES)}{fill(pick(paths))}", 1) for name in foul]
            noise = "".join(pick("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rng.integers(14, 26)))
            out.append((f"http://{noise}.{pick(_BAD_SUFFIXES)}{fill(pick(paths))}", 1))
            out.append((f"{scheme()}://{front()}{word()}{pick(['', '-'])}{word()}.{pick(_BAD_SUFFIXES)}{fill(pick(spam))}", 1))
        out += [(f"{scheme()}://{host}{fill(pick(paths))}", 0) for host in _GOOD_HOSTS]
        out += [(f"{scheme()}://{host}{fill(pick(serve))}", 1) for host in _BAD_HOSTS]
    return out


def host_of(url: str | None) -> str:
    m = re.match(PARTS, url or "")
    return m[1].lower() if m else ""


def _domain(host: str) -> str:
    """The suffix and the label before it."""
    rest = host[: len(host) - len(_suffix(host))].rstrip(".")
    return f"{rest.rsplit('.', 1)[-1]}.{_suffix(host)}"


def host_grams(host: str) -> list[str]:
    """Runs of four letters (or three, where a word has no more) in the labels before the suffix, but for www."""
    words = set(WORDS.findall(host[: len(host) - len(_suffix(host))])) - {"www"}
    return sorted({w[i : i + 4] for w in words for i in range(max(1, len(w) - 3))})


def _entropy(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values()) if s else 0.0


def _suffix(host: str) -> str:
    """The last label, with the one before it where that is a country's com, co, org and the like."""
    labels = host.split(".")
    return ".".join(labels[-2:] if len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in {"ac", "co", "com", "edu", "gov", "net", "org"} else labels[-1:])


def features(url: str | None, suffixes: dict[str, tuple[int, int]], overall: float, label: int | None = None, grams: dict[str, tuple[int, int]] | None = None) -> list[float]:
    """Lexical features of one URL. suffixes: (URLs, blocked ones) by suffix and by domain; grams: (hosts, blocked ones) by letters of the host.

    A labelled URL's own label, and its own host, are taken out.
    """
    url = url or ""
    m = re.match(PARTS, url)
    host, path = (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")
    query = url[m.end() :].split("#")[0].lstrip("?") if m else ""
    seen, bad = suffixes.get(_suffix(host), (0, 0))
    seen_domain, bad_domain = suffixes.get(_domain(host), (0, 0))
    if label is not None:
        seen, bad, seen_domain, bad_domain = max(0, seen - 1), max(0, bad - label), max(0, seen_domain - 1), max(0, bad_domain - label)
    rates = []
    for w in host_grams(host):
        hosts, blocked = (grams or {}).get(w, (0, 0))
        if label is not None:
            hosts, blocked = max(0, hosts - 1), max(0, blocked - label)
        rates.append((blocked + 2 * overall) / (hosts + 2))
    letters = sum(c.isalpha() for c in host) or 1
    digits = sum(c.isdigit() for c in url)
    return [
        len(url), len(host), host.count(".") + 1, max(map(len, host.split("."))), host.count("-"), digits / max(1, len(url)), sum(c.isdigit() for c in host), _entropy(host),
        len(path), sum(bool(x) for x in path.split("/")), _entropy(path), query.count("=") + query.count("&") if query else 0, len(query), url.count("%"),
        sum(c in "aeiouy" for c in host) / letters, (bad + 20 * overall) / (seen + 20), math.log1p(seen), max(rates, default=overall), sum(rates) / len(rates) if rates else overall,
        (bad_domain + 2 * overall) / (seen_domain + 2),
    ]


class BoostedTrees:
    """Trees of a fixed depth over quantile bins; the logistic loss, fitted by Newton steps."""

    def __init__(self, depth: int = 3, rounds: int = 60, rate: float = 0.2, bins: int = 32, ridge: float = 1.0):
        self.depth, self.rounds, self.rate, self.bins, self.ridge = depth, rounds, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = self._binned(x)
        p0 = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.base, self.trees = math.log(p0 / (1 - p0)), []
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node, feature, cut = np.zeros(len(y), np.int64), [], []
            for level in range(self.depth):
                n = 1 << level
                best = np.full(n, -1.0)
                bf, bc = np.zeros(n, np.int64), np.full(n, self.bins, np.int64)
                for j in range(x.shape[1]):
                    at = node * self.bins + b[:, j]
                    left_g, left_h = (np.bincount(at, v, n * self.bins).reshape(n, self.bins).cumsum(axis=1) for v in (g, h))
                    all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                    gain = left_g**2 / (left_h + self.ridge) + (all_g - left_g) ** 2 / (all_h - left_h + self.ridge) - all_g**2 / (all_h + self.ridge)
                    k = gain.argmax(axis=1)
                    better = gain[np.arange(n), k] > best + 1e-9
                    best[better], bf[better], bc[better] = gain[np.arange(n), k][better], j, k[better]
                feature.append(bf)
                cut.append(bc)
                node = node * 2 + (b[np.arange(len(y)), bf[node]] > bc[node])
            n = 1 << self.depth
            value = self.rate * np.bincount(node, g, n) / (np.bincount(node, h, n) + self.ridge)
            self.trees.append((feature, cut, value))
            f += value[node]
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        b, rows = self._binned(x), np.arange(len(x))
        f = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for bf, bc in zip(feature, cut):
                node = node * 2 + (b[rows, bf[node]] > bc[node])
            f += value[node]
        return 1 / (1 + np.exp(-f))


class UrlModel:
    def __init__(self, labelled: list[tuple[str, int]]):
        y = np.array([label for _, label in labelled], float)
        self.overall = float(y.mean()) if len(y) else 0.0
        self.suffixes: dict[str, tuple[int, int]] = {}
        for url, label in labelled:
            m = re.match(PARTS, url or "")
            host = m[1].lower() if m else ""
            for s in (_suffix(host), _domain(host)):
                seen, bad = self.suffixes.get(s, (0, 0))
                self.suffixes[s] = (seen + 1, bad + label)
        hosts: dict[str, int] = {}
        for url, label in labelled:
            hosts[host_of(url)] = max(label, hosts.get(host_of(url), 0))
        self.grams: dict[str, tuple[int, int]] = {}
        for host, label in hosts.items():
            for w in host_grams(host):
                seen, bad = self.grams.get(w, (0, 0))
                self.grams[w] = (seen + 1, bad + label)
        x = np.array([features(u, self.suffixes, self.overall, label, self.grams) for u, label in labelled]).reshape(-1, len(FEATURES))
        self.trees = BoostedTrees().fit(x, y) if len(labelled) else None

    def score(self, urls: list[str | None]) -> np.ndarray:
        if self.trees is None or not urls:
            return np.zeros(len(urls))
        return self.trees.predict(np.array([features(u, self.suffixes, self.overall, grams=self.grams) for u in urls]))


def learn(labelled: DataFrame, url: str = "url", label: str = "blocked", max_urls: int = 20_000) -> UrlModel:
    """Trees fitted on about max_urls labelled URLs, drawn by a hash. Null URLs and labels are left out."""
    rows = labelled.filter(F.col(url).isNotNull() & F.col(label).isNotNull()).select(F.col(url).alias("url"), F.col(label).cast("int").alias("label"))
    share = min(1.0, max_urls / max(1, rows.count()))
    drawn = rows.filter(F.xxhash64(F.lit("url"), "url").cast("double") / 2.0**64 + 0.5 < share) if share < 1 else rows
    return UrlModel(sorted((r["url"], r["label"]) for r in drawn.collect()))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], model: UrlModel, url: str = "url", threshold: float = 0.5, into: str = "filter") -> DataFrame:
    """pages with a struct column `into`: host, path, rule, verdict (block or allow), score (the trees').

    Host: after the first :// up to /, ? or #, A-Z lower-cased. Path: then up to ? or #. A null URL, or one without ://,
    has both empty, fits no rule and is judged by the trees alone, as is an empty host. A rule fits its host and all
    subdomains if the path starts with the rule's; the longest rule wins, and of equally long ones the first given. A score
    of just the threshold blocks. URLs are read whole, whatever their length. Repeated rows are judged alike. All columns
    stay, whatever their names, but for one called `into`, which the result replaces. An empty table gives an empty result.
    """
    u = F.coalesce(F.col(url), F.lit(""))
    host, path = ascii_lower(F.regexp_extract(u, PARTS, 1)), F.regexp_extract(u, PARTS, 2)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for urls in batches:
            yield pd.Series(model.score([None if v is None else v for v in urls]))

    parts = pages.withColumn(into, F.struct(host.alias("host"), path.alias("path"), F.pandas_udf(score, "double")(u).alias("score")))
    rule, verdict = F.lit(None).cast("string"), F.when(F.col(into)["score"] >= threshold, "block").otherwise("allow")
    for h, p, v in sorted(reversed(rules), key=lambda r: len(r[0] + r[1])):
        fits = ((F.col(into)["host"] == h) | F.col(into)["host"].endswith("." + h)) & F.col(into)["path"].startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return parts.withColumn(into, F.struct(F.col(into)["host"].alias("host"), F.col(into)["path"].alias("path"), rule.alias("rule"), verdict.alias("verdict"), F.col(into)["score"].alias("score")))


def op10_url_filter(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES, UrlModel(seed())).select("page_id", "filter.*")


QUERIES = {"op10_url_filter": op10_url_filter}
SQL: dict[str, str] = {}
