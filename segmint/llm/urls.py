"""URL filters: ordered site rules, then logistic regression on hashed
character n-grams of host and path, trained from a small labelled URL table.

All steps are column expressions and Spark ML stages, which run in the JVM;
the model is a bounded coefficient vector (``BUCKETS``).
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: (host, path, verdict); a rule covers its host and all subdomains.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))
BUCKETS, SIZES, THRESHOLD = 4096, (3, 4), 0.5

#: The labelled URL table: host names and paths of unwanted and wanted kinds.
BLOCKED = ("casino-win.example.com/en/1", "www.free-bets.example.net/en/2.html", "cheap-pills.example.com/de/3",
           "online-casino.example.net/play", "best-casino-bonus.example.com/slots", "sports-bets.example.com/odds",
           "free-poker.example.net/en/77", "win-money-now.example.com/", "pills-shop.example.org/buy",
           "cheap-meds.example.net/order", "viagra-store.example.com/en/9", "adult-dating.example.com/chat",
           "xxx-videos.example.net/watch", "hot-singles.example.com/join", "payday-loans.example.com/apply",
           "free-spins.example.net/casino", "lottery-win.example.com/claim", "replica-watches.example.com/sale",
           "porn-tube.example.net/fr/12", "bets-online.example.org/live", "crypto-doubler.example.com/invest",
           "free-download-crack.example.net/keygen", "escort-city.example.com/es/4", "slots-jackpot.example.com/en/3")
ALLOWED = ("blog.tionsh.example.com/en/12.html", "www.example.org/de/5", "news.example.net/fr/77/",
           "therhe.example.org/en/8423", "docs.python.example.org/tutorial/", "m.library.example.net/books/9",
           "university.example.com/research/", "wiki.example.org/history", "weather.example.com/en/today",
           "ththst.example.com/es/1837/", "museum.example.net/fr/art", "recipes.example.com/de/soup.html",
           "onreou.example.net/en/44", "school.example.org/lessons/3", "travel.example.com/es/guide",
           "city-council.example.net/minutes", "health.example.org/advice/flu", "ghther.example.net/fr/90.html",
           "music-review.example.com/albums/5", "garden.example.net/plants/", "science.example.org/en/physics",
           "www.edstion.example.com/en/1291/", "journal.example.net/2020/05/", "m.thanon.example.com/fr/7424")


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://`` up to ``/``, ``?``, ``#`` or the
    end, A-Z lower-cased; path from there up to ``?``, ``#`` or the end.  Both
    empty for a null URL or one without ``://``."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule string, verdict) of the longest rule that fits, else null."""
    which, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        which, verdict = F.when(fits, F.lit(h + p)).otherwise(which), F.when(fits, F.lit(v)).otherwise(verdict)
    return which, verdict


def _grams(df: DataFrame) -> DataFrame:
    """The characters of host and path, with marks for their borders."""
    text = F.concat(F.lit("^"), F.col("host"), F.lit("|"), F.col("path"), F.lit("$"))
    return df.withColumn("_chars", F.split(text, ""))


def fit(labelled: DataFrame) -> PipelineModel:
    """A model from (url, label 0/1; 1: block).  The table is small by contract:
    it is trained in one partition, so the fit is the same on every run."""
    host, path = parts(F.col("url"))
    rows = _grams(labelled.select(host.alias("host"), path.alias("path"), F.col("label").cast("double").alias("label")))
    stages = [NGram(n=n, inputCol="_chars", outputCol=f"_g{n}") for n in SIZES]
    hashed = HashingTF(numFeatures=BUCKETS, binary=True, inputCol="_grams", outputCol="_features")
    grams = Pipeline(stages=stages).fit(rows)
    joined = grams.transform(rows).withColumn("_grams", F.concat(*(f"_g{n}" for n in SIZES)))
    model = LogisticRegression(featuresCol="_features", labelCol="label", regParam=0.01, maxIter=60).fit(
        hashed.transform(joined).coalesce(1))
    return PipelineModel([*stages, hashed, model])


def score(urls: DataFrame, model: PipelineModel) -> DataFrame:
    """``urls`` (host, path, ...) and ``block_score``, the probability of block."""
    *stages, hashed, lr = model.stages
    out = PipelineModel(stages).transform(_grams(urls)).withColumn("_grams", F.concat(*(f"_g{n}" for n in SIZES)))
    out = lr.transform(hashed.transform(out))
    return out.select(*urls.columns, vector_to_array("probability")[1].alias("block_score"))


def labelled_table(spark: SparkSession) -> DataFrame:
    """The labelled URL table (literals, built in the JVM)."""
    rows = lambda urls, label: spark.range(1, numPartitions=1).select(
        F.explode(F.array(*(F.lit("https://" + u) for u in urls))).alias("url"), F.lit(label).alias("label"))
    return rows(BLOCKED, 1).unionByName(rows(ALLOWED, 0))


def judge(pages: DataFrame, model: PipelineModel, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score for each row of ``pages``.

    Null URLs and URLs without ``://`` have an empty host and path and get the
    model's verdict for them.  Repeated rows give repeated results.
    """
    host, path = parts(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    which, said = rule(F.col("host"), F.col("path"), rules)
    scored = score(split.withColumns({"rule": which, "_said": said}), model)
    verdict = F.coalesce("_said", F.when(F.col("block_score") >= THRESHOLD, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_score")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), fit(labelled_table(spark)))
