"""URL verdicts: path rules first, then logistic regression on hashed character n-grams.

Features are character n-grams of host and path, hashed to ``2**BITS`` places, those of the host apart from
those of the path. The model is trained on the driver from a small labelled table of URLs (at
most MAX_LABELLED rows, by default LABELLED below) and is one vector of fixed size.

Defined results: a null URL or one without ``://`` has an empty host and path, which no rule fits;
repeated rows are judged alike; an empty table gives an empty table; columns named like the outputs
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraweave.llm.common import without

BITS = 16
SIZES = (3, 4, 5)
MAX_LABELLED = 10_000
#: Of the squared weights. The best of 1e-2 to 1e-6 over folds of whole words.
PENALTY = 1e-5
#: The probability from which a URL is blocked: over the same folds the recall of blocked words is above 0.8 from here down.
THRESHOLD = 1 / 3

#: Words of hosts and paths by verdict, in English, German, French and Spanish; each line holds the relatives of one idea.
ALLOWED_WORDS = """
library bibliothek bibliotheque biblioteca bookshelf
music musik musique musica concert konzert
history historia histoire geschichte historic
science ciencia wissenschaft scientific research recherche
university universite universidad universitaet campus
museum museo musee gallery galerie galeria
garden garten jardin jardinage gardening
recipe rezept recette receta cooking cocina cuisine
weather wetter meteo tiempo forecast
school schule ecole escuela schoolbook
news noticias nachrichten actualites newspaper zeitung
health gesundheit sante salud hospital hopital
travel reisen voyage viajes traveller
football fussball futbol rugby handball cycling radsport
politics politik politique politica parliament parlament
language sprache langue lengua grammar grammatik
software programming programmieren programmation programacion developer
mathematics mathematik mathematiques matematicas algebra
physics physik physique fisica astronomy astronomie
nature natur naturaleza forest foret bosque wald
railway bahn chemin ferrocarril station bahnhof
theatre theater teatro opera ballet
photography fotografie photographie fotografia camera-club
community gemeinde commune comunidad village dorf
article artikel articulo journal essay
philosophy philosophie filosofia ethics ethik
economy wirtschaft economie economia statistics statistik
kitchen-garden bakery baeckerei boulangerie panaderia
wiki encyclopedia enzyklopaedie encyclopedie enciclopedia
letters lettres cartas briefe poetry poesie poesia
biology biologie biologia botany botanik
weekly wochenblatt hebdo semanario bulletin
""".split()
BLOCKED_WORDS = """
poker pokern pokerroom videopoker
roulette ruleta roulett blackjack baccarat
jackpot jackpots slots slotmachine tragamonedas spielautomaten
kasino kasinos gambling gamble gambler glucksspiel
betting bettor wetten sportwetten wettbonus apuestas bookmaker bookie
lotto lottery loteria loterie bingo
porn porno pornos pornstar pornhd
sex sexe sexo sexy sexcam sexchat
erotic erotik erotique erotica erotico
nude nudes naked nackt desnudas nudist-pics
escort escorts hookup hookups callgirls fuck
adultos adulte xxx xxxvideos milfs
viagra viagras cialis kamagra levitra
pillen pilules pastillas rxmeds meds pharm-discount
steroids steroide anabolika weightloss slimming
payday paydayloans loan loans loanshark kredit-sofort
bitcoin-doubler cryptodouble forexsignals forexprofit getrich
replica replicas fakewatches rolexreplica counterfeit
warez crackz keygen keygens serialz nulled
torrentz pirated piratemovies camrip
adserver adclick adclicks popads popunder adbanner
clicktracker trackingpixel tracker redirector clickbait
spammer spamming linkfarming backlinks seolinks
phishing phish malware trojan ransom hackedaccounts
giveaways freebies prizes gewinnspiel winner-claim
essaywriters papermill fakediploma fakepassport
""".split()
#: What hosts of both verdicts are put together with.
NEUTRAL_WORDS = """online world best my top new 24 club hub zone direct plus pro city land central vip fast full mega super live video chat room
shark date track buy hot guide data notes house star point box line link net web page group team time day home open""".split()
_FRAMES = ("http://{}.site/", "https://{}.info/index.php?id={}", "https://portal.{}.eu/view/{}", "http://{}.co/p/{}", "https://{}.xyz/{}", "http://home.{}.biz/page-{}")


def labelled() -> list[tuple[str, int, str]]:
    """``(url, blocked, word)``: every word as a host alone, with neutral words before and behind it, with the next word of its list, and as
    a path. Both verdicts share the neutral words and the frames, so these tell nothing; a URL that tells nothing at all is allowed."""
    out = []
    for words, blocked in ((ALLOWED_WORDS, 0), (BLOCKED_WORDS, 1)):
        for i, w in enumerate(words):
            near = [NEUTRAL_WORDS[(i * k + k) % len(NEUTRAL_WORDS)] for k in (1, 3, 7)]
            dash, after = "-" * (i % 2), words[(i + 1) % len(words)]
            for j, host in enumerate((w, near[0] + dash + w, w + dash + near[1], near[2] + w, w + dash + after)):
                out.append((_FRAMES[(i + j) % len(_FRAMES)].format(host, 37 * i % 1000), blocked, w))
            out.append((f"https://server{i * 7 % 90}.site/{w}/{11 * i % 500}", blocked, w))
    return out + [(f.format(n, 5 * i), 0, n) for i, n in enumerate(NEUTRAL_WORDS) for f in _FRAMES[1:3]] + [("", 0, "")] * 12


#: ``(url, blocked)``. All hosts are invented.
LABELLED = [(u, b) for u, b, _ in labelled()]


def _grams(host: str, path: str) -> np.ndarray:
    """Distinct places of the n-grams of ``^host$`` and ``^path$``."""
    found = []
    for space, text in ((1, host), (2, path)):
        codes = np.frombuffer(f"^{text}$".encode(), np.uint8).astype(np.uint64) + np.uint64(1)
        for n in SIZES:
            if len(codes) >= n:
                h = np.full(len(codes) - n + 1, n * 4 + space, np.uint64)
                for i in range(n):
                    h = (h * np.uint64(1_099_511_628_211)) ^ codes[i : len(codes) - n + 1 + i]
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                found.append(h >> np.uint64(64 - BITS))
    return np.unique(np.concatenate(found)).astype(np.int64) if found else np.zeros(0, np.int64)


def split_url(url: str | None) -> tuple[str, str]:
    """The host and path that ``host_of`` and ``path_of`` give."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path


def train(labelled: Iterable[tuple[str, int]] = tuple(LABELLED), penalty: float = PENALTY, steps: int = 600) -> np.ndarray:
    """Weights, the last one for the bias: the least of the mean logistic loss, both verdicts weighing alike, and ``penalty / 2`` times the squared weights, by
    accelerated gradient descent. A row's n-grams weigh one over the root of their number."""
    rows = list(labelled)
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"a labelled table has {MAX_LABELLED} rows at most")
    places = [np.r_[_grams(*split_url(url)), 1 << BITS] for url, _ in rows]
    sizes = np.array([len(p) for p in places])
    flat, row = np.concatenate(places), np.repeat(np.arange(len(rows)), sizes)
    value = 1 / np.sqrt(np.maximum(sizes - 1, 1))[row]
    value[np.cumsum(sizes) - 1] = 1
    y = np.array([float(b) for _, b in rows])
    share = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w = v = np.zeros((1 << BITS) + 1)
    step = 1 / (0.5 + penalty)  # a row's squared length is 2 at most, a quarter of which bounds the loss's curvature
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.bincount(row, value * v[flat], len(rows))))
        new = v - step * (np.bincount(flat, value * (share * (p - y))[row], len(v)) + penalty * v)
        w, v = new, new + k / (k + 3) * (new - w)
    return w


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^(?>.*?://)[^/?#]*(/[^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule ``host/path`` that fits, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):  # the last one that fits wins
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def judge(df: DataFrame, rules: dict[str, str], url: str = "url", weights: np.ndarray | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule``, ``score`` (the model's probability of a block; null where a
    rule decides) and ``verdict``."""
    model = train() if weights is None else weights

    @F.pandas_udf("double")
    def score(host: pd.Series, path: pd.Series) -> pd.Series:
        out = np.empty(len(host))
        for i, (h, p) in enumerate(zip(host, path)):
            at = _grams(h, p)
            out[i] = model[at].sum() / np.sqrt(max(len(at), 1)) + model[-1]
        return pd.Series(1 / (1 + np.exp(-out)))

    base = without(df, *(c for c in ("host", "path", "rule", "score", "verdict") if c != url))
    split = base.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    ruled = split.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("__tw_score", score("host", "path"))
    decided = reduce(lambda out, r: F.when(F.col("rule") == r, F.lit(rules[r])).otherwise(out), rules, F.when(F.col("__tw_score") >= threshold, F.lit("block")).otherwise(F.lit("allow")))
    return ruled.withColumn("score", F.when(F.col("rule").isNull(), F.col("__tw_score"))).withColumn("verdict", decided).drop("__tw_score")
