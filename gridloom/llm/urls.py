"""URL verdicts: explicit rules first, else logistic regression on hashed character n-grams.

Everything runs as DataFrame functions. Host and path are cut out of the url; each contributes its character n-grams
(with marks at both ends), hashed to one of ``buckets`` weights, host and path apart. Training is one row: the labelled
table, which is small by contract (``most_rows``; more is an error, none is dropped), is gathered into arrays and full
batch gradient descent runs over them in a higher-order function. The model that comes back has ``buckets + 1`` numbers.

Defined results: a url that is null or has no ``://`` has an empty host and path and is judged by the bias alone; rows
with equal page_id are rows of their own; of rules with equal length the one with the longer host, then the first in
order, wins; an empty table gives an empty result; an empty labelled table gives a model that allows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import constants

#: Fixed values: (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: A small labelled table; 1 is to be blocked.
ALLOWED = (
    "https://www.example.com/en/articles/history-of-printing.html",
    "https://docs.example.org/guide/getting-started",
    "http://library.example.net/catalog/item/48213",
    "https://blog.example.edu/en/2021/05/gardening-notes",
    "https://en.example.com/wiki/Photosynthesis",
    "https://news.example.org/world/2020/11/03/election-report",
    "http://www.example.net/departments/physics/lectures/12",
    "https://museum.example.edu/collections/paintings/oil",
    "https://www.example.com/reports/annual/2019.html",
    "https://recipes.example.org/soup/lentil-soup",
    "https://science.example.net/journal/vol12/paper7",
    "http://m.example.edu/en/story/51234",
    "https://forum.example.com/topic/8812/how-to-fix-a-bicycle",
    "https://travel.example.org/guides/lisbon/",
    "https://www.example.net/es/noticias/ciencia",
    "https://www.example.edu/fr/actualites/culture",
    "https://www.example.com/de/wissen/geschichte",
    "http://poetry.example.org/archive/sonnets/18",
    "https://weather.example.net/forecast/region/7",
    "https://maths.example.edu/courses/algebra/notes.html",
    "https://health.example.com/topics/nutrition",
    "https://code.example.org/projects/parser/readme",
    "https://school.example.net/teachers/resources/reading",
    "http://archive.example.edu/books/1890/travels",
    "https://www.example.org/en/articles/birds-of-the-coast.html",
    "https://docs.example.com/reference/parser/options",
    "http://library.example.edu/books/catalog/1712",
    "https://blog.example.net/2019/08/notes-on-gardening",
    "https://fr.example.org/wiki/Histoire_de_la_peinture",
    "https://news.example.com/science/2022/02/14/report-on-weather",
    "http://www.example.edu/departments/history/courses/7",
    "https://museum.example.org/exhibitions/paintings-and-drawings",
    "https://www.example.net/reports/quarterly/2021.html",
    "https://recipes.example.com/bread/rye-bread",
    "https://journal.example.edu/science/vol3/paper12",
    "http://m.example.com/fr/story/8841",
    "https://forum.example.org/topic/311/reading-list-for-teachers",
    "https://travel.example.net/guides/coast-and-islands/",
    "https://www.example.edu/es/noticias/historia",
    "https://www.example.com/fr/culture/musique",
    "https://www.example.org/de/nachrichten/wissenschaft",
    "http://archive.example.net/poetry/1820/letters",
    "https://weather.example.com/region/coast/forecast",
    "https://courses.example.org/maths/geometry/lectures/4",
    "https://health.example.edu/guide/nutrition-and-sleep",
    "https://code.example.com/docs/readme.html",
    "https://school.example.org/teachers/lectures/physics",
    "http://books.example.edu/archive/travels-in-the-north",
    "https://www.example.net/en/wiki/Printing_press",
    "https://guides.example.com/getting-started/garden",
    "https://en.example.edu/history/of/mathematics",
    "https://catalog.example.org/item/paintings/3391",
    "https://story.example.com/archive/2015/06/election",
    "https://physics.example.net/notes/lecture-9.html",
)
BLOCKED = (
    "http://casino-bonus.example.com/free-spins?ref=x",
    "http://win-cash-now.example.org/lottery/claim",
    "https://xxx-videos.example.net/watch/8812",
    "http://cheap-pills.example.edu/buy/viagra-online",
    "http://adult-cams.example.com/live/girls",
    "http://download-crack.example.org/keygen/serial.exe",
    "http://poker-online.example.net/play-now",
    "https://track.example.edu/click?aff=9921&offer=22",
    "http://payday-loans.example.com/apply/fast-cash",
    "http://free-iphone.example.org/winner/prize",
    "http://ads.example.net/banner/redirect?utm_source=feed",
    "http://hot-singles.example.edu/dating/near-you",
    "http://torrent-movies.example.com/download/full-hd",
    "http://replica-watches.example.org/sale/cheap",
    "http://slots-jackpot.example.net/casino/bet",
    "http://weight-loss-miracle.example.edu/buy-now",
    "http://click-here.example.com/redirect/offer/win",
    "http://porn-tube.example.org/video/123",
    "http://betting-tips.example.net/odds/bet-now",
    "http://warez.example.edu/serial/crack/keygen",
    "http://seo-backlinks.example.com/buy/links-cheap",
    "http://earn-money-fast.example.org/bitcoin/double",
    "http://escort.example.net/gallery/xxx",
    "http://sweepstakes.example.edu/claim/prize?ref=x",
    "http://free-spins.example.org/casino/bonus?ref=q",
    "http://lottery-winner.example.com/claim/cash-now",
    "https://porn-videos.example.edu/watch/xxx/77",
    "http://buy-viagra.example.net/cheap-pills/online",
    "http://live-cams.example.org/adult/girls-now",
    "http://crack-keygen.example.com/download/serial",
    "http://online-casino.example.edu/poker/play-now",
    "https://click.example.net/track?offer=8&aff=12",
    "http://fast-loans.example.org/payday/apply-now",
    "http://win-iphone.example.com/free/prize/claim",
    "http://redirect.example.edu/ads/banner?utm_source=mail",
    "http://dating-singles.example.net/hot/near-you",
    "http://movies-download.example.org/torrent/full-hd",
    "http://cheap-watches.example.com/replica/sale",
    "http://jackpot-slots.example.edu/bet/casino",
    "http://miracle-pills.example.net/weight-loss/buy-now",
    "http://offer.example.org/click-here/win/redirect",
    "http://xxx-tube.example.com/porn/video/9",
    "http://bet-now.example.edu/betting/odds",
    "http://serial-crack.example.net/warez/download",
    "http://buy-backlinks.example.org/seo/cheap",
    "http://double-bitcoin.example.com/earn/money-fast",
    "http://adult-escort.example.edu/girls/gallery",
    "http://claim-prize.example.net/sweepstakes/winner",
    "http://casino-slots.example.com/free/jackpot",
    "http://online-pills.example.org/cheap/buy",
    "http://hot-girls.example.net/live/cams/xxx",
    "http://cash-loans.example.edu/fast/apply",
    "http://download-movies.example.com/free/full-hd",
    "http://click-offer.example.org/aff/redirect?ref=z",
)


def folded(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_parts(urls: DataFrame, url: str = "url") -> DataFrame:
    """``host`` and ``path`` of each url."""
    form = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, form, i), F.lit(""))
    return urls.withColumn("host", folded(part(1))).withColumn("path", part(2))


def grams(sizes: Sequence[int], buckets: int) -> Column:
    """Buckets of the n-grams of host and path, as they come."""

    def of(part: str, tag: int) -> list[Column]:
        chars = F.col(f"_{part}")

        def gram(n: int):
            return lambda i: F.pmod(F.xxhash64(F.lit(tag * 16 + n), *[F.get(chars, i + k) for k in range(n)]), F.lit(buckets)).cast("int")

        return [F.transform(F.when(F.size(chars) >= n, F.sequence(F.lit(0), F.size(chars) - n)).otherwise(F.array().cast("array<int>")), gram(n)) for n in sizes]

    return F.concat(*of("host", 0), *of("path", 1))


def with_grams(parts: DataFrame, sizes: Sequence[int], buckets: int) -> DataFrame:
    """``_grams``: buckets of all n-grams. Characters are put in arrays first, so that long texts cost their length only."""
    chars = lambda part: F.filter(F.split(F.concat(F.lit("^"), F.col(part), F.lit("$")), ""), lambda c: c != "")
    return parts.withColumn("_host", chars("host")).withColumn("_path", chars("path")).withColumn("_grams", grams(sizes, buckets)).drop("_host", "_path")


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def margin(found: Column, weights: Column, buckets: int) -> Column:
    """Bias and the sum of the weights met, over the root of their number."""
    total = F.aggregate(found, F.lit(0.0), lambda a, i: a + F.get(weights, i))
    return F.get(weights, F.lit(buckets)) + total / F.sqrt(F.greatest(F.size(found), F.lit(1)))


def train(labelled: DataFrame, sizes: Sequence[int] = (3, 4), buckets: int = 2048, rounds: int = 60, rate: float = 2.0, decay: float = 0.002, most_rows: int = 10_000) -> list[float]:
    """Weights and, last, the bias; labelled: (url, label), label 1 to block."""
    rows = labelled.where("url is not null and label is not null")
    n = rows.count()
    if n > most_rows:
        raise ValueError(f"the labelled table has {n} rows; the bound is {most_rows}")
    if not n:
        return [0.0] * buckets + [-1.0]
    each = with_grams(with_parts(rows), sizes, buckets)
    # a total order of rows, so that every run sums in the same order
    each = each.groupBy(F.lit(0).alias("one")).agg(F.array_sort(F.collect_list(F.struct(F.col("url"), F.col("label").cast("double").alias("y"), F.col("_grams").alias("g"), (1 / F.sqrt(F.greatest(F.size("_grams"), F.lit(1)))).alias("s")))).alias("rows"))
    # for each bucket: the rows that hold it, once for each time
    met = each.select(F.posexplode("rows").alias("r", "row")).select("r", F.col("row.s").alias("s"), F.explode("row.g").alias("b")).groupBy("b").agg(F.array_sort(F.collect_list(F.struct("r", "s"))).alias("l"))
    met = met.groupBy(F.lit(0).alias("one")).agg(F.map_from_entries(F.collect_list(F.struct("b", "l"))).alias("met"))
    lists = F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.element_at("met", b))
    one = each.join(met, "one").select("rows", lists.alias("lists"))

    def step(w: Column, _: Column) -> Column:
        off = F.transform("rows", lambda r: sigmoid(margin(r["g"], w, buckets)) - r["y"])
        return F.aggregate(F.array(off), w, lambda old, o: F.concat(F.zip_with(F.slice(old, 1, buckets), F.col("lists"), lambda v, l: v - rate * (decay * v + F.coalesce(F.aggregate(l, F.lit(0.0), lambda a, x: a + F.get(o, x["r"]) * x["s"]), F.lit(0.0)) / n)), F.array(F.get(old, F.lit(buckets)) - rate * F.aggregate(o, F.lit(0.0), lambda a, x: a + x) / n)))

    start = F.array_repeat(F.lit(0.0), buckets + 1)
    return list(one.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step).alias("w")).first()[0])


def seed_table(spark: SparkSession) -> DataFrame:
    rows = [f"('{u}', 0)" for u in ALLOWED] + [f"('{u}', 1)" for u in BLOCKED]
    return spark.sql("select * from values " + ", ".join(rows) + " as t(url, label)")


def rule_for(rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """Rule string and verdict of the longest rule that fits ``host`` and ``path``, null if none does."""
    name = verdict = None
    for what, rule in sorted(rules, key=lambda r: (-len(r[1]), -len(r[1].partition("/")[0]))):
        host, slash, rest = rule.partition("/")
        at = F.col("host")
        fits = ((at == host) | F.endswith(at, F.lit("." + host))) & F.startswith(F.col("path"), F.lit(slash + rest))
        name = F.when(fits, F.lit(rule)) if name is None else name.when(fits, F.lit(rule))
        verdict = F.when(fits, F.lit(what)) if verdict is None else verdict.when(fits, F.lit(what))
    empty = F.lit(None).cast("string")
    return (empty, empty) if name is None else (name, verdict)


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules: Sequence[tuple[str, str]] = RULES, sizes: Sequence[int] = (3, 4), buckets: int = 2048) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row; the score is the model's probability to block."""
    weights = train(seed_table(pages.sparkSession) if labelled is None else labelled, sizes, buckets)
    table = constants(weights, "double")
    rule, verdict = rule_for(rules)
    parts = with_grams(with_parts(pages.select("page_id", F.col("url").cast("string").alias("url"))), sizes, buckets)
    known = F.when((F.col("host") == "") & (F.col("path") == ""), F.array().cast("array<int>")).otherwise(F.col("_grams"))
    judged = parts.withColumn("score", sigmoid(margin(known, table, buckets))).withColumn("rule", rule)
    method = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce(verdict, method).alias("verdict"), "score")
