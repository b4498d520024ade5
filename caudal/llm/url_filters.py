"""URL filter: allow and block rules first, then logistic regression on hashed character n-grams of host and path.

Everything runs as DataFrame expressions. The model is fitted by full-batch gradient descent (Adagrad: a bucket's step shrinks
with its past slopes, so that rare n-grams learn as fast as common ones), one aggregation for each step, on a small labelled
table; its weights (at most BUCKETS numbers, whatever the input) come to the driver and go back into the plan as one constant array.

Defined cases: a null URL, or one without `://`, has empty host and path, takes no rule and is allowed; a port is part of the
host; of two `://` the first counts; a very long URL is judged whole; of rules of equal length that both fit (they can only be
equal) the last counts; log-odds of exactly 0 allow; repeated rows are judged alike; an empty table gives an empty result;
extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

BUCKETS, STEPS, RATE = 1 << 16, 12, 0.2
SIZES = (3, 4)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The labelled table, of general words only (none is read from pages). Blocked words and ordinary ones get the same
#: COMPANIONS, so that only the words tell them apart; ordinary words that share n-grams with blocked ones stand among them.
BLOCKED = (
    "casino poker slots jackpot roulette blackjack bets betting sportsbook gambling porn porno sex sexy xxx adult adults nude naked erotic escort escorts cams "
    "camgirls milf viagra cialis pills steroids pharma payday loans replica rolex warez crack cracks keygen torrent malware phishing spam spammer backlinks "
    "linkfarm ads adserver adclick popads tracker clickbait freespins giveaway prizes lottery forex getrich cryptoprofit"
).split()
COMPANIONS = "online free best cheap shop club video tube hub king royal live fast quick bonus now buy top city world".split()
ALLOWED = (
    "library museum school science history journal weather garden kitchen travel music health sports radio university archive research city-news daily-post the-times "
    "open-data wiki books forum blog gazette clinic theatre recipes parish council observatory orchard academy airport alumni aquarium architecture artgallery astronomy "
    "athletics bakery banking baptist bicycle biology birdwatch bookshop botany brewery bridge cathedral ceramics chamber charity chemistry choir church cinema citizen "
    "climate coastguard college community company conference consulting cooking county craft culture cycling dance dentist design diary dictionary digital doctor driving "
    "economics education electric energy engineering environment express factory family farming fashion festival fishing fitness flowers football foundation gallery geology "
    "government grammar guardian guidebook hardware harvest heritage hiking hospital hotel housing insurance international italian kindergarten knitting language law-firm "
    "lawyers learning lighthouse literature magazine maps marathon market mathematics mechanics medicine memorial meteorology mountain nature neighbours network newspaper "
    "northern nursery opera optician orchestra painting parliament pharmacy philosophy photography physics pianist planning poetry police pottery press primary-school "
    "printing psychology publisher quarterly railway reading review rowing sailing scouts sculpture seaside secondary security shipping skating society software southern "
    "stadium statistics students surgery swimming teaching technology telegraph tennis translation transport tribune tutorials valley veterinary village vineyard volunteer "
    "wildlife winery woodland workshop writers yearbook youth zoology the-other another-thing thoughts thunder together weather-report "
    "online-shop online-banking online-library learn-online freedom free-library free-press free-theatre freelance wine-cellar winter windows winchester twin-towns "
    "alphabet better-homes abetterworld diabetes tibet essex sussex middlesex unisex sextant adult-education adult-learning young-adults cheap-eats cheap-books pharmacology "
    "spammers-beware farm-shop farmhouse city-farm dairy-farm wind-farm links-golf golf-links spillway pillar caterpillar slotcars timeslot jackets clickers "
    "tracks railtracks racetrack fast-track fitness-tracker parcel-track soundtrack adsorption roads heads threads loadstone loans-library student-loans prize-draw "
    "nobel-prize book-prize winners cracking-science crackers login-help video-archive video-lessons chatham hotspring hotels richmond enrich watches watchmaker moneybox "
    "pixel-art cameras webcam-weather girls-school banner-makers bonus-track cityguide quickstart royal-society lucky-charms kingdom"
).split()
PARENTS = ("example.com", "example.net", "example.org", "com", "org", "net")
PATHS = ("/en/1", "/de/273.html", "/fr/840?page=2", "/es/61/", "/", "", "/en/592", "/de/77")


def names_of(words: list[str], companions: int) -> list[str]:
    """The words alone and each with some companions, before or behind it, with or without a hyphen."""
    names = list(words)
    for i, word in enumerate(words):
        for j in range(companions):
            other, gap = COMPANIONS[(3 * i + 7 * j) % len(COMPANIONS)], ("-", "", "-")[(i + j) % 3]
            names.append(f"{word}{gap}{other}" if (i + j) % 2 else f"{other}{gap}{word}")
    return names


def training_urls() -> list[tuple[str, int]]:
    """(url, 1 to block): rows made from the word lists by a rule, about as many of either kind."""
    rows = []
    for label, names in ((1, names_of(BLOCKED, 9)), (0, names_of(ALLOWED, 1))):
        for i, name in enumerate(names):
            for j in range(4):
                front = ("", "www.", "m.", "blog.")[(i + j) % 4]
                rows.append((f"https://{front}{name}.{PARENTS[(i + 2 * j) % 6]}{PATHS[(i + 3 * j) % 8]}", label))
    return rows


def training_table(spark: SparkSession) -> DataFrame:
    rows = [{"url": url, "label": label} for url, label in training_urls()]
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<url: string, label: int>>")))


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty if there is none."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; both null if none does. rules: (host/path, allow or block)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, then in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(then)).otherwise(verdict)
    return rule, verdict


def gram_buckets(host: Column, path: Column) -> Column:
    """Array of the buckets of all character n-grams of `^host$` and of the path."""

    def hashed(mark: str, grams: Column) -> Column:
        return F.transform(grams, lambda g: F.pmod(F.xxhash64(F.lit(mark), g), F.lit(BUCKETS)).cast("int"))

    parts = []
    for mark, text in (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", path)):
        parts += [hashed(mark, F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), 1)) for n in SIZES]
    return F.concat(*parts)


def margin(buckets: Column, weights: list[float], intercept: float) -> Column:
    """The model's log-odds of block; n-gram counts are divided by the square root of their number."""
    constant = F.from_json(F.lit(json.dumps([w or 0 for w in weights])), "array<double>")
    total = F.aggregate(buckets, F.lit(0.0), lambda acc, b: acc + F.get(constant, b))
    return F.lit(intercept) + total / F.sqrt(F.greatest(F.size(buckets), F.lit(1)).cast("double"))


def fit(labelled: DataFrame) -> tuple[list[float], float]:
    """Weights and intercept from rows of url and label, by gradient descent; only bucket sums reach the driver."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = table(labelled.select(F.col("label").cast("double").alias("label"), gram_buckets(host, path).alias("buckets")), "urls")
    n = rows.count()
    weights, intercept, past, past_of_all = [0.0] * BUCKETS, 0.0, [1e-24] * BUCKETS, 1e-24
    for _ in range(STEPS):
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin(F.col("buckets"), weights, intercept)))
        miss = rows.select((p - F.col("label")).alias("miss"), "buckets")
        each = miss.select("miss", F.sqrt(F.greatest(F.size("buckets"), F.lit(1)).cast("double")).alias("root"), F.explode(F.concat(F.array(F.lit(-1)), F.col("buckets"))).alias("bucket"))
        part = F.when(F.col("bucket") == -1, F.col("miss")).otherwise(F.col("miss") / F.col("root"))
        slopes = dict(each.groupBy("bucket").agg(F.sum(part)).collect())
        slope = slopes.pop(-1, 0.0) / n
        past_of_all += slope * slope
        intercept -= RATE * slope / math.sqrt(past_of_all)
        for bucket, total in slopes.items():
            slope = total / n
            past[bucket] += slope * slope
            weights[bucket] = round(weights[bucket] - RATE * slope / math.sqrt(past[bucket]), 6)
    return [round(w, 6) for w in weights], round(intercept, 6)


def judge(pages: DataFrame, rules: list[tuple[str, str]], weights: list[float], intercept: float) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row of pages (page_id, url)."""
    cut = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    scored = cut.withColumns({"rule": rule, "by_rule": verdict, "log_odds": margin(gram_buckets(F.col("host"), F.col("path")), weights, intercept)})
    said = F.when((F.col("host") != "") & (F.col("log_odds") > 0), F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("by_rule", said).alias("verdict"), "log_odds")


RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights, intercept = fit(training_table(spark))
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES, weights, intercept)
