"""URL filter: host and path rules, and a logistic regression on character n-grams (operator 9).

The model is trained on the driver from a small labelled table (``UNWANTED`` and ``WANTED``, or
the caller's own, at most ``MAX_TRAINING`` rows). Features are hashed 3- to 5-grams of the host
and of the path, apart from each other, with marks at both ends; each part is scaled by the root
of its number of n-grams, so long paths don't drown hosts. A rule decides before the model does: it fits
its host and all subdomains if the path starts with the rule's path, and the longest rule wins.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower
case. Path: then up to ``?``, ``#`` or the end.

Cases: a null url or one without ``://`` has an empty host and an empty path; its verdict is the
model's for empty strings, which have no n-grams, so the model's intercept decides (it leans to
allow). White space and other characters are kept as they are. Repeated rows are judged each;
an empty table gives no rows; long urls are scored whole.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1 << 16
SIZES = (3, 4, 5)
MAX_TRAINING = 5000

# The small labelled table: urls as a filter for training data wants or doesn't want them.
UNWANTED = """
casino-royal.com/slots/play casinobonus.net/en/free-spins best-casino.org/blackjack online-casino.com/win
poker-stars-bets.com/tables free-poker.net/room1 bet365win.com/odds sports-betting.net/live free-bets-now.org/12
betting-tips.com/football win-jackpot.net/lottery lucky-slots.org/spin casino-winner.net/bonus big-win-casino.org/44
cheap-viagra.com/order pills-online.net/buy cheap-meds.org/pharmacy discount-pills.com/cialis buy-pills.net/no-prescription
pharmacy-cheap.org/viagra cheap-pharma-pills.com/en/31 weight-loss-pills.net/offer pill-shop.org/cart
xxx-videos.com/watch adult-chat.net/cams free-porn.org/tube porn-hd.com/clips adult-dating.net/girls sexcams.org/live
adult-xxx.com/gallery hot-adult.net/pics adultx-movies.org/17 nude-pics.com/album escort-adult.net/city
spam-mail.com/offer spam-links.net/seo link-farm.org/directory linkfarm-seo.com/links farm-spam.net/page/3 spamfarm.org/x
ads-server.com/banner adtrack.net/click track-ads.org/pixel click-tracker.com/redirect adserver-tracking.net/beacon popup-ads.org/show
ad-tracking.com/imp banner-ads.net/track ads-clicks.org/go affiliate-track.com/out
free-iphone.com/claim payday-loans.net/apply quick-loans.org/cash get-rich-quick.com/start warez-crack.net/download
keygen-serial.org/crack free-money.com/now replica-watches.net/rolex work-from-home-cash.org/earn crypto-doubler.com/deposit
www.spam-blog.net/en/12 www.spamfarms.com/fr/7 m.spam-site.org/en/200 blog.link-spam.com/de/9.html spam.net/es/31 www.farm-of-links.net/en/4
blog.casino-guide.com/en/301 m.casinos.net/de/18 www.casino-games.org/es/2 www.free-bet.com/en/61 bets-today.net/fr/90 m.bets.org/en/7
blog.pills-shop.com/en/45 www.cheap-drugs.org/de/77.html m.pills.net/fr/8 www.adult-site.net/en/3 blog.adults-only.org/fr/21 m.xxx.net/es/14
www.ads-network.net/en/52 m.ad-track.org/fr/36 blog.trackers-ads.com/en/11.html www.tracking-ads.net/de/5 cheapest-offers.com/en/10
""".split()

WANTED = """
wikipedia.org/wiki/Earth docs.python.org/3/library news.bbc.co.uk/world nature.com/articles/s41 arxiv.org/abs/1706
gutenberg.org/ebooks/84 stanford.edu/courses mit.edu/research nasa.gov/missions loc.gov/item europa.eu/policies
github.com/apache/spark spark.apache.org/docs stackoverflow.com/questions/11 medium.com/story recipes.com/soup
blog.gardening.net/en/roses travel-stories.org/fr/paris www.museum.org/de/ausstellung m.theguardian.com/books
lemonde.fr/culture spiegel.de/politik elpais.com/cultura zeit.de/wissen lefigaro.fr/sciences abc.es/historia
weather.com/forecast maps.org/city openstreetmap.org/node library.net/catalog school.org/en/200 university.net/de/physik
history-today.com/rome blog.photography.net/fr/34.html chess.org/games music-theory.net/chords poetry.org/es/12
health.gov/vaccines hospital.org/doctors m.newspaper.net/en/560 www.townhall.org/en/council science-daily.com/space
cooking.net/es/pan bird-watching.org/owls railways.net/timetable blog.mother.org/de/garten weaving.com/en/wool
www.thread.net/en/77 m.other.com/fr/9 blog.station.org/en/15 thinking.net/en/logic heather.com/de/3 nations.org/en/un
rethink.net/es/400 anthem.org/fr/27 bathing.com/en/beach lathe-work.net/en/901.html mention.org/de/6 motion.com/en/80
the-hill.net/en/410 tablet.org/fr/61 ablation.net/en/72 ration.com/es/19 www.ether.net/de/533 blog.wither.org/en/8.html
english-grammar.com/verbs leather.net/fr/118 m.feather.org/en/230 nothing.com/de/74 editions.net/es/66 thorn.org/en/490
www.tension.net/en/12 edge.com/fr/302 station.net/de/81 blog.hither.com/en/640 author.org/es/250 onion.net/en/33
www.thousands.net/en/150 m.throat.net/de/18.html blog.theatre.net/fr/23 thunder.net/en/6 www.trouble-shooting.net/en/205 m.hat-makers.com/de/74
www.hound.net/en/11 www.month.org/de/9 m.athens.net/fr/61 www.double-bass.com/en/15
""".split()


def split_url(url: str) -> tuple[str, str]:
    """Host and path of a url of the labelled table, written without a scheme."""
    host, slash, path = url.partition("/")
    return host, slash + path


def grams(kind: str, text: str) -> np.ndarray:
    """Hashed n-grams of one part, distinct; none for an empty part."""
    if not text:
        return np.zeros(0, np.int64)
    s = f"^{text}$"
    found = {f"{kind}{s[k:k + n]}" for n in SIZES for k in range(len(s) - n + 1)}
    return np.array(sorted({zlib.crc32(g.encode("utf-8", "replace")) % DIMENSIONS for g in found}), np.int64)


def train(rows: list[tuple[str, str, int]], steps: int = 500, rate: float = 4.0, decay: float = 5e-4) -> tuple[np.ndarray, float]:
    """Weights and intercept from rows (host, path, 1 for unwanted), by gradient descent on all rows."""
    if len(rows) > MAX_TRAINING:
        raise ValueError(f"the labelled table has over {MAX_TRAINING} rows")
    at, value, row = [], [], []
    for k, (host, path, _) in enumerate(rows):
        for kind, part in (("h", host), ("p", path)):
            g = grams(kind, part)
            at.append(g)
            value.append(np.full(len(g), 1 / max(1.0, len(g)) ** 0.5))
            row.append(np.full(len(g), k))
    at, value, row = (np.concatenate(x) if x else np.zeros(0) for x in (at, value, row))
    y = np.array([r[2] for r in rows], float)
    share = y.mean() if len(y) else 0.0
    weight = np.where(y == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)) / max(1, len(y))
    w, b = np.zeros(DIMENSIONS), -1.0
    for _ in range(steps):
        z = np.bincount(row, value * w[at], len(rows)) + b
        g = (1 / (1 + np.exp(-z)) - y) * weight
        w -= rate * (np.bincount(at, value * g[row], DIMENSIONS) + decay * w)
        b -= 0.02 * rate * g.sum()
    return w.astype(np.float32), float(b)


def labelled() -> list[tuple[str, str, int]]:
    return [(*split_url(u), 1) for u in UNWANTED] + [(*split_url(u), 0) for u in WANTED]


def host_and_path(url: Column) -> tuple[Column, Column]:
    found = F.instr(url, "://")
    rest = F.when(found > 0, F.substring(url, found + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, upper, upper.lower()), path


def rule_column(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null without one. ``rules``: (host/path, verdict), a short list."""
    which, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):      # the last that fits is the longest
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        which, verdict = F.when(fits, rule).otherwise(which), F.when(fits, says).otherwise(verdict)
    return which, verdict


def judge(pages: DataFrame, rules: list[tuple[str, str]], rows: list[tuple[str, str, int]] | None = None,
          threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(train(labelled() if rows is None else rows))
    key = pages.schema["page_id"].dataType.simpleString()

    def run(it):
        w, b = shared.value
        seen: dict[str, float] = {}

        def part(kind: str, text: str) -> float:
            g = grams(kind, text)
            return float(w[g].sum()) / max(1.0, len(g)) ** 0.5

        for batch in it:
            scores = []
            for host, path in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist()):
                if host not in seen:
                    if len(seen) > 100_000:
                        seen.clear()
                    seen[host] = part("h", host)
                z = seen[host] + part("p", path) + b
                scores.append(1 / (1 + np.exp(-z)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path")), pa.array(scores, pa.float64())],
                                             names=["page_id", "host", "path", "score"])

    host, path = host_and_path(F.col("url").cast("string"))
    scored = (pages.select("page_id", host.alias("host"), path.alias("path"))
              .mapInArrow(run, f"page_id {key}, host string, path string, score double"))
    rule, says = rule_column(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, own).alias("verdict"), "score")
