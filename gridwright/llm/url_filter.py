"""URL filters: host and path rules, and a logistic regression on hashed character n-grams.

All of it is DataFrame expressions. Rules are a short policy list and become one expression; the
longest fitting rule decides. Other urls are judged by a logistic regression (MLlib) on the counts
of hashed n-grams of host and path, trained from a small labelled URL table; its coefficients are
a literal array of ``BUCKETS`` numbers, so scoring needs no shuffle.

Defined results: a null url or one without :// has an empty host and path, fits no rule and is
judged by the intercept; user names and ports are part of the host; an empty labelled table, or
one with a single label, allows everything that no rule blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, SIZES = 1024, (3, 4)
#: Labelled URLs that training takes at most.
MOST_LABELLED = 2000

# The policy of the query. (host, path, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

# Words of the small labelled table: hosts and paths of unwanted and of ordinary pages.
UNWANTED = ("spam-farm", "casino", "cheap-pills", "free-prize", "adult-cam", "quick-loan",
            "bet-now", "warez")
ORDINARY = ("library", "university", "news", "weather", "museum", "recipes", "docs", "forum",
            "school", "garden", "history", "science", "travel", "music", "energy", "health",
            "bridge", "harbour", "station", "theatre", "kitchen", "painter", "market", "letters")
PLACES = ("www.{w}.example.net/en/1", "{w}.example.com/index.html", "blog.{w}.net/fr/7",
          "m.example.net/{w}/de/42.html", "{w}.net/", "example.com/es/{w}")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The labelled URL table (url, unwanted)."""
    rows = [(f"https://{p.format(w=w)}", int(words is UNWANTED))
            for words in (UNWANTED, ORDINARY) for w in words for p in PLACES]
    return spark.createDataFrame(rows, "url string, unwanted int")


def split_url(url: str = "url") -> tuple[Column, Column]:
    """Host with A-Z in lower case, and path."""
    after = F.coalesce(
        F.when(F.instr(F.col(url), "://") > 0,
               F.substr(F.col(url), F.instr(F.col(url), "://") + 3)), F.lit(""))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    ascii_lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return ascii_lower, path


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as a struct of its length, text and verdict, or null."""
    fits = [
        F.when(
            ((host == h) | host.endswith(f".{h}")) & path.startswith(p),
            F.struct(F.lit(len(h) + len(p)).alias("n"), F.lit(h + p).alias("rule"),
                     F.lit(v).alias("verdict")))
        for h, p, v in rules
    ]
    none = F.lit(None).cast("struct<n int, rule string, verdict string>")
    return F.array_max(F.array_compact(F.array(none, *fits)))


def grams(host: Column, path: Column) -> Column:
    """Buckets of the character n-grams of ``^host`` and ``path$``."""
    text = F.concat(F.lit("^"), host, F.lit(" "), path, F.lit("$"))

    def of(t: Column, size: int) -> Column:
        last = F.greatest(F.char_length(t) - size + 1, F.lit(1))
        return F.transform(
            F.sequence(F.lit(1), last),
            lambda i: F.pmod(F.xxhash64(F.substring(t, i, F.lit(size))), F.lit(BUCKETS)))

    # The text is the variable of an outer transform, so that it is worked out once per row and
    # not once per n-gram.
    each = F.transform(F.array(text), lambda t: F.concat(*[of(t, n) for n in SIZES]))
    return F.element_at(each, 1)


def trained(labelled: DataFrame) -> tuple[list[float], float]:
    """Coefficients and intercept; a positive score means unwanted."""
    host, path = split_url()
    rows = labelled.where("unwanted in (0, 1)").orderBy(F.xxhash64("url"), "url").limit(
        MOST_LABELLED).select(
        F.col("unwanted").cast("double").alias("label"), grams(host, path).alias("grams")
    ).coalesce(1).cache()  # keeps the n-grams from being worked out once per bucket
    counts = F.transform(
        F.sequence(F.lit(0), F.lit(BUCKETS - 1)),
        lambda b: F.size(F.filter("grams", lambda g: g == b)).cast("double"))
    labels = {r.label for r in rows.select("label").distinct().collect()}
    if len(labels) < 2:
        return [0.0] * BUCKETS, -1.0
    vectors = rows.select("label", array_to_vector(counts).alias("features"))
    model = LogisticRegression(maxIter=40, regParam=0.02, standardization=False).fit(vectors)
    rows.unpersist()
    return [float(x) for x in model.coefficients], float(model.intercept)


def judged(
    pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES
) -> DataFrame:
    """``pages`` with host, path, rule, verdict and score in place of columns of these names."""
    pages = pages.drop("host", "path", "rule", "verdict", "score", "_rule")
    weights, intercept = trained(labelled)
    host, path = split_url()
    table = F.array(*[F.lit(w) for w in weights])
    score = F.aggregate(
        grams(F.col("host"), F.col("path")), F.lit(intercept),
        lambda total, g: total + F.element_at(table, (g + 1).cast("int")))
    with_parts = pages.withColumns({"host": host, "path": path})
    rule = best_rule(F.col("host"), F.col("path"), rules)
    return with_parts.withColumns({"_rule": rule, "score": score}).withColumns({
        "rule": F.col("_rule.rule"),
        "verdict": F.coalesce(
            F.col("_rule.verdict"), F.when(F.col("score") > 0, "block").otherwise("allow")),
    }).drop("_rule")


def query(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    return judged(pages, labelled_urls(spark)).select("page_id", "host", "path", "rule", "verdict")
