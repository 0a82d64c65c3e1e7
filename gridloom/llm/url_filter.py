"""URL filters: host and path rules, and for the rest a logistic regression on hashed character n-grams of host and path.

The model is trained from a small labelled URL table by DataFrame expressions alone. Its rows' n-grams are hashed into a fixed
number of buckets; the table's inner products (a join on the bucket) give the weights in terms of the rows, so all epochs of
gradient descent are one higher-order expression over one row. The model that scores is one weight a bucket, whatever the
size of the data; scoring reads each URL once, without a shuffle.

Defined results. Null URL, or one without ``://``: host and path empty, no rule, the model's verdict on empty strings (its
bias). Strings shorter than an n-gram are one n-gram. Repeated rows: each is returned. Empty table: empty result. Empty
labelled table: no weights; every URL without a rule is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, SIZES, EPOCHS, RATE, RIDGE = 1024, (3, 4), 150, 0.5, 0.01

# fixed values: the rules of the shipped list, (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

# fixed values: a small labelled table, invented hosts; 1 is to be blocked
BLOCKED_URLS = (
    "http://free-casino-bonus.example/win/now", "http://best-casino-slots.example/jackpot", "http://cheap-pills-online.example/buy/viagra",
    "http://hot-singles-tonight.example/adult/chat", "http://xxx-adult-video.example/free/porn", "http://loan-fast-cash.example/apply/now",
    "http://crypto-doubler.example/invest/win", "http://replica-watches-sale.example/cheap/rolex", "http://click-tracker.ads.example/redirect/click",
    "http://banner.adserver.example/ads/pop", "http://download-crack-keygen.example/warez/free", "http://torrent-movies-free.example/download/full",
    "http://win-prize-lottery.example/claim/prize", "http://seo-backlinks-cheap.example/buy/links", "http://phishing-login-verify.example/account/verify",
    "http://betting-odds-free.example/bonus/bet", "http://spam-mailer.example/unsubscribe/track", "http://poker-online-bonus.example/free/chips",
    "http://miracle-diet-pills.example/buy/slim", "http://popunder.ads.example/pop/under",
)
ALLOWED_URLS = (
    "https://www.university.example/research/papers", "https://docs.project.example/guide/install", "https://news.daily.example/world/report",
    "https://library.city.example/catalog/books", "https://blog.engineer.example/posts/design", "https://museum.history.example/exhibits/ancient",
    "https://www.recipes.example/dinner/soup", "https://forum.gardening.example/topics/roses", "https://www.weather.example/forecast/week",
    "https://school.district.example/calendar/term", "https://wiki.science.example/article/physics", "https://www.journal.example/volume/issue",
    "https://travel.guide.example/en/cities", "https://m.magazine.example/fr/culture", "https://shop.handmade.example/de/products",
    "https://www.government.example/services/forms", "https://help.software.example/manual/reference", "https://photos.nature.example/gallery/birds",
    "https://music.theory.example/lessons/chords", "https://www.hospital.example/patients/visit",
)


def host_of(url: Column) -> Column:
    """What stands behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty if there is none."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What stands behind the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits ``host`` and ``path``, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def buckets(host: Column, path: Column, n_buckets: int = BUCKETS, sizes: tuple[int, ...] = SIZES) -> Column:
    """Bucket numbers of all n-grams of host and path; a field's name is part of the hash."""

    def grams(text: Column, field: str, n: int) -> Column:
        starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))).when(F.length(text) > 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(f"{field}{n}"), F.substring(text, i, F.lit(n))), F.lit(n_buckets)).cast("int"))

    return F.concat(*(grams(text, field, n) for text, field in ((host, "h"), (path, "p")) for n in sizes))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The shipped table: ``url`` and ``label``; a local relation of literals."""
    rows = [(u, 1) for u in BLOCKED_URLS] + [(u, 0) for u in ALLOWED_URLS]
    table = F.array(*(F.struct(F.lit(u).alias("url"), F.lit(y).alias("label")) for u, y in rows))
    return spark.range(1).select(F.explode(table).alias("r")).select("r.url", "r.label")


def train(labelled: DataFrame, max_rows: int = 400, epochs: int = EPOCHS, rate: float = RATE, ridge: float = RIDGE) -> tuple[float, list[float]]:
    """Bias and bucket weights, from at most ``max_rows`` labelled rows (by a hash of the URL).

    With weights w = sum_i alpha_i x_i, a gradient step on the log-loss with ridge penalty is
    alpha_i <- alpha_i (1 - rate ridge) + rate (y_i - sigmoid(sum_j K_ij alpha_j + bias)), where K = X X'; the bias
    moves by rate times the mean error.
    """
    rows = labelled.where(F.col("label").isin(0, 1)).select("url", F.col("label").cast("double").alias("y")).orderBy(F.xxhash64("url"), "url", "y").limit(max_rows)
    numbered = rows.groupBy().agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("url").alias("h"), "url", "y"))).alias("all")).select(F.posexplode("all").alias("i", "r"))
    grams = numbered.select("i", F.col("r.y").alias("y"), buckets(host_of(F.col("r.url")), path_of(F.col("r.url"))).alias("b"))
    x = grams.select("i", F.size("b").alias("n"), F.explode("b").alias("b")).groupBy("i", "n", "b").agg(F.count(F.lit(1)).alias("c")).select("i", "b", (F.col("c") / F.sqrt("n")).alias("x"))
    x2 = x.select(F.col("i").alias("j"), "b", F.col("x").alias("x2"))
    gram = x.join(x2, "b").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("x2")).alias("k"))
    line = gram.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "k"))).alias("near"))
    table = grams.select("i", "y").join(line, "i", "left").groupBy().agg(F.sort_array(F.collect_list(F.struct("i", "y", "near"))).alias("t"))
    start = F.struct(F.transform("t", lambda _: F.lit(0.0)).alias("a"), F.lit(0.0).alias("bias"))

    def error(acc: Column) -> Column:
        margin = lambda r: F.aggregate(F.coalesce(r["near"], F.array().cast("array<struct<j:int,k:double>>")), acc["bias"], lambda s, e: s + e["k"] * F.element_at(acc["a"], e["j"] + 1))
        return F.transform("t", lambda r: r["y"] - 1 / (1 + F.exp(-margin(r))))

    def step(acc: Column, _: Column) -> Column:
        moved = F.zip_with(acc["a"], error(acc), lambda a, e: a * (1 - rate * ridge) + rate * e)
        # the bias follows the mean error; what a move adds to a shrunken weight is rate times the error
        added = F.aggregate(F.zip_with(moved, acc["a"], lambda m, a: m - a * (1 - rate * ridge)), F.lit(0.0), lambda s, e: s + e)
        return F.struct(moved.alias("a"), (acc["bias"] + added / F.greatest(F.size("t"), F.lit(1))).alias("bias"))

    solved = table.select(F.aggregate(F.sequence(F.lit(1), F.lit(epochs)), start, step).alias("m"))
    alpha = solved.select("m.bias", F.posexplode("m.a").alias("i", "a"))
    weights = x.join(alpha, "i").groupBy("b").agg(F.sum(F.col("x") * F.col("a")).alias("w"))
    out = [0.0] * BUCKETS
    for r in weights.collect():  # at most one row a bucket
        out[r["b"]] = r["w"]
    bias = solved.select("m.bias").first()["bias"]
    return float(bias or 0.0), out


def url_verdicts(pages: DataFrame, labelled: DataFrame | None = None, rules: tuple[tuple[str, str, str], ...] = RULES, url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and the model's ``block_score`` (0 to 1) of every URL."""
    bias, weights = train(labelled if labelled is not None else labelled_urls(pages.sparkSession))
    w = F.array(*map(F.lit, weights))
    parts = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    b = buckets(F.col("host"), F.col("path"))
    total = F.aggregate(b, F.lit(0.0), lambda s, i: s + F.get(w, i))
    scored = parts.withColumn("block_score", 1 / (1 + F.exp(-(F.lit(bias) + total / F.sqrt(F.greatest(F.size(b), F.lit(1)))))))
    rule, verdict = rule_columns(rules)
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("block_score") > 0.5, "block").otherwise("allow")).alias("verdict"), "block_score")
