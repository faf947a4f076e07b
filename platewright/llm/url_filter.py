"""URL filter: rules on hosts and paths first, then logistic regression on hashed character n-grams.

The features of a URL are the n-grams of its host and of its path, marked by field, hashed to a fixed number of
buckets, each bucket counted once. The model is fitted on a small table of labelled URLs. Weights are whole
multiples of 2^-16, so a URL's sum is the same in whatever order its n-grams are added.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The contract's rules as (host, path, verdict); a rule's name is host + path.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
SIZES = (3, 4, 5)
BUCKETS = 1 << 14
# The rolling hash: h * FACTOR + code point + 1 modulo a prime, so that SQL can repeat it in 64 bits.
FACTOR, PRIME = 1_000_003, (1 << 31) - 1
HOST, PATH = 1, 2
SCALE = 1 << 16
PULL = 0.02
# Labelled rows that are fitted at most: those of smallest hash of the URL.
MOST_LABELS = 20_000

# A small labelled table of made-up addresses of the usual kinds; another one is passed as a DataFrame.
BLOCKED = """
http://casino-royal-bonus.test/free-spins/win-now
https://best-online-casino.test/poker/bonus?ref=77
http://slots-jackpot-win.test/play.html
https://www.bet-win-casino.test/en/slots
http://poker-bonus-cash.test/join
https://cheap-viagra-pills.test/buy-now
http://discount-pharmacy-online.test/viagra-cialis.html
https://buy-pills-cheap.test/no-prescription/order
http://xxx-adult-videos.test/free/porn
https://hot-sex-cams.test/live-girls
http://porn-tube-free.test/xxx/video1.html
https://adult-dating-now.test/hookup/singles
http://free-money-fast.test/earn-cash-today
https://get-rich-quick.test/make-money-online.html
http://payday-loans-instant.test/apply-now
https://cheap-loans-cash.test/credit/fast
http://win-free-iphone.test/claim-prize
https://you-are-winner.test/lottery/prize?id=9
http://spam-links-farm.test/seo/backlinks
https://buy-backlinks-seo.test/cheap-traffic
http://link-farm-directory.test/submit/links.html
https://content-farm-articles.test/spin/article-8812
http://clickbait-spam.test/you-wont-believe
https://free-download-crack.test/keygen-serial.html
http://warez-torrent-crack.test/full-movie-download
https://pirate-movies-free.test/watch-online-hd
http://replica-watches-cheap.test/rolex/sale
https://fake-designer-bags.test/outlet/discount
http://weight-loss-miracle.test/diet-pills
https://miracle-cure-secret.test/doctors-hate
http://login-verify-account.test/secure/update-password
https://bank-account-verify.test/confirm/login.php
http://crypto-double-profit.test/invest-now
https://bitcoin-bonus-free.test/giveaway/claim
http://malware-popup-ads.test/install-now.exe
https://adclick-redirect.test/out?url=offer
http://gambling-bets-live.test/odds/bonus
https://sportsbet-freebet.test/signup-bonus
http://escort-girls-city.test/rates
https://nude-pics-free.test/gallery/teen
http://bulk-email-spam.test/mailing-lists
https://cheap-followers-likes.test/buy-instagram
http://spam-blog-network.test/category/loans
https://free-ringtones-win.test/subscribe
http://casino-spam-offers.test/promo/win-big
https://viagra-farm.test/shop/cheap
http://hacked-accounts-sale.test/cards/cvv
https://essay-cheap-writing.test/order-essay
http://mega-jackpot-lotto.test/win/ticket
https://pills-store-discount.test/buy/cheap
""".split()
ALLOWED = """
https://docs.language.test/library/json.html
https://www.city-library.test/opening-hours
http://blog.gardening.test/en/planting-tomatoes.html
https://news.daily.test/world/2021/05/elections
https://en.encyclopedia.test/wiki/Photosynthesis
https://www.university.test/physics/courses/101
https://m.weather.test/forecast/paris
http://blog.travelnotes.test/2019/08/lisbon
https://www.museum.test/collections/painting/42
https://research.institute.test/papers/climate.pdf
https://recipes.kitchen.test/soup/lentil.html
http://www.history.test/articles/roman-roads
https://support.software.test/kb/install-guide
https://www.hospital.test/patients/visiting
https://code.project.test/repo/issues/17
http://forum.cycling.test/thread/1204?page=2
https://www.parliament.test/bills/2020/health
https://school.district.test/calendar/spring
https://blog.photography.test/en/lenses.html
https://www.theatre.test/programme/autumn
http://maps.region.test/trails/north
https://journal.medicine.test/vol12/article3
https://www.standards.test/iso/units
https://m.newspaper.test/economy/trade.html
https://books.publisher.test/authors/catalogue
http://www.astronomy.test/planets/saturn
https://science.magazine.test/biology/cells
https://blog.teacher.test/lesson-plans/fractions
https://www.airport.test/departures?page=1
https://wiki.linux.test/kernel/modules
http://radio.station.test/schedule/monday
https://www.chess.test/openings/sicilian
https://archive.records.test/letters/1890
https://www.transport.test/timetable/trains#top
https://art.gallery.test/exhibitions/current/
http://blog.music.test/fr/concerts.html
https://www.statistics.test/population/tables
https://legal.advice.test/tenancy/rights
https://m.football.test/results/league?page=3
https://www.ocean.test/species/whales/
http://network.engineering.test/protocols/tcp
https://www.thesaurus.test/words/bright
https://data.open.test/sets/rainfall
https://www.nature-reserve.test/birds/heron
http://blog.cooking.test/es/recetas/sopa
https://www.grammar.test/english/tenses
https://math.lectures.test/algebra/groups
https://www.farmers-market.test/stalls/vegetables
http://www.geology.test/rocks/granite.html
https://poetry.review.test/issues/spring?utm_source=feed
""".split()


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) by the contract; a null or an address without ``://`` has neither."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    return host.translate(_LOWER), path


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


class Rules:
    """Rules by host, so that a URL looks up its own host and the domains above it, however many rules there are."""

    def __init__(self, rules):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for host, path, verdict in rules:
            self.by_host.setdefault(host, []).append((path, verdict))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits; of equally long ones the smaller name, block before allow."""
        best = None
        while True:
            for start, verdict in self.by_host.get(host, ()):
                if path.startswith(start):
                    found = (-len(host + start), host + start, verdict != "block", verdict)
                    best = min(best, found) if best else found
            dot = host.find(".")
            if dot < 0:
                return (best[1], best[3]) if best else None
            host = host[dot + 1 :]


def buckets(host: str, path: str) -> np.ndarray:
    """Distinct buckets of the n-grams of both fields. Digits count as 0, A-Z as a-z, and marks stand at the ends."""
    found = []
    for field, value in ((HOST, host), (PATH, path)):
        marked = "^" + re.sub("[0-9]", "0", value.translate(_LOWER)) + "$"
        codes = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64) + 1
        for size in SIZES:
            n = len(codes) - size + 1
            if n > 0:
                h = np.full(n, field, dtype=np.int64)
                for k in range(size):
                    h = (h * FACTOR + codes[k : k + n]) % PRIME
                found.append(h % BUCKETS)
    return np.unique(np.concatenate(found)) if found else np.empty(0, dtype=np.int64)


class Model:
    """Whole-number weights per bucket and the bias, all in units of 1 / SCALE."""

    def __init__(self, weights: np.ndarray, bias: int):
        self.weights, self.bias = weights, bias

    def log_odds(self, host: str, path: str) -> float:
        """Of blocking: the bias plus the summed weights over the root of the number of buckets."""
        own = buckets(host, path)
        return (self.bias + int(self.weights[own].sum()) / math.sqrt(max(1, len(own)))) / SCALE


def fit(urls: list[str], blocked: list[int], pull: float = PULL, rounds: int = 400) -> Model:
    """Ridge-penalised logistic regression by accelerated gradient steps.

    Both classes weigh the same in total. Without rows of both classes nothing is known: all weights are 0.
    """
    y = np.array(blocked, dtype=float)
    weights = np.zeros(BUCKETS, dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return Model(weights, 0)
    own = [buckets(*split_url(u)) for u in urls]
    used = np.unique(np.concatenate(own))
    place = {int(b): i for i, b in enumerate(used)}
    columns = np.concatenate([[place[int(b)] for b in x] for x in own]).astype(np.int64)
    rows = np.repeat(np.arange(len(own)), [len(x) for x in own])
    value = np.repeat([1 / math.sqrt(max(1, len(x))) for x in own], [len(x) for x in own])
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w, before, bias, bias_before = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    # Rows have length one, so the curvature of the mean loss is at most 1/4 for the weights and the bias each.
    rate = 1 / (0.5 + pull)
    for t in range(rounds):
        ahead, ahead_bias = w + t / (t + 3) * (w - before), bias + t / (t + 3) * (bias - bias_before)
        z = np.bincount(rows, weights=value * ahead[columns], minlength=len(y)) + ahead_bias
        slope = share * (1 / (1 + np.exp(-z)) - y)
        before, bias_before = w, bias
        w = ahead - rate * (np.bincount(columns, weights=value * slope[rows], minlength=len(used)) + pull / len(y) * ahead)
        bias = ahead_bias - rate * slope.sum()
    weights[used] = np.rint(w * SCALE).astype(np.int64)
    return Model(weights, round(bias * SCALE))


def default_labels() -> tuple[list[str], list[int]]:
    return [*BLOCKED, *ALLOWED], [1] * len(BLOCKED) + [0] * len(ALLOWED)


def learn(labelled: DataFrame | None = None, url: str = "url", blocked: str = "blocked", most: int = MOST_LABELS) -> Model:
    """The model of a table of labelled URLs (blocked 0 or 1), or of the built-in one.

    Rows without URL or label are left out. Of a larger table the ``most`` rows of smallest hash are fitted.
    """
    if labelled is None:
        return fit(*default_labels())
    rows = labelled.select(F.col(url).alias("u"), F.col(blocked).cast("int").alias("b")).where("u is not null and b in (0, 1)")
    rows = rows.orderBy(F.xxhash64("u"), "u", "b").limit(most).collect()
    return fit([r.u for r in rows], [r.b for r in rows])


JUDGED = "host string, path string, rule string, verdict string, log_odds double"


def verdicts(url: Column, model: Model, rules=RULES, threshold: float = 0.0) -> Column:
    """struct(host, path, rule, verdict, log_odds) of each URL; the model judges only where no rule fits."""
    listed = tuple(rules)

    @F.pandas_udf(JUDGED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Rules(listed)
        for batch in batches:
            out = []
            for one in batch:
                host, path = split_url(one)
                fits = known.match(host, path)
                if fits:
                    out.append((host, path, *fits, None))
                else:
                    odds = model.log_odds(host, path)
                    out.append((host, path, None, "block" if odds > threshold else "allow", odds))
            yield pd.DataFrame(out, columns=["host", "path", "rule", "verdict", "log_odds"])

    return run(url)


def judge(
    pages: DataFrame, url: str = "url", page_id: str = "page_id", rules=RULES, labelled: DataFrame | None = None,
    threshold: float = 0.0,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, log_odds`` for every row.

    The longest rule that fits decides; ``log_odds`` is null there. Elsewhere the model blocks where its log-odds are
    above ``threshold``. A null URL, an empty one or one without ``://`` has an empty host and path, which no rule fits
    and the model judges by its bias and the two empty fields. Hosts keep ports and user names as they are. Repeated rows
    keep a row each; an empty table gives no rows; further columns are ignored. Row-local: no shuffle.
    """
    found = verdicts(F.col(url), learn(labelled), rules, threshold)
    return pages.select(F.col(page_id).alias("page_id"), found.alias("v")).select("page_id", "v.*")


def keep_allowed(pages: DataFrame, url: str = "url", **settings) -> DataFrame:
    """The rows whose URL is allowed, all columns as they were."""
    model = learn(settings.pop("labelled", None))
    kept = pages.withColumn("_verdict", verdicts(F.col(url), model, **settings)["verdict"]).where("_verdict = 'allow'")
    return kept.select(*[F.col(f"`{c}`") for c in pages.columns])
