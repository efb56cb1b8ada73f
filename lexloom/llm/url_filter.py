"""URL filter: rules for hosts and their subdomains, and else a logistic regression on hashed character n-grams.

The model is trained from a small labelled table, which is made from the words and patterns below or given by the caller.
Features are the distinct n-grams of host and path, hashed into ``DIM`` places; the fitted weights are one constant array, so
scoring is a sum inside the projection. Everything on the way is DataFrame functions and the JVM's logistic regression.
"""

from __future__ import annotations

import json

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import ascii_lower, named, table

DIM = 2048
GRAM = 4
MAX_RULES = 10_000

#: (host, path, verdict) of the standing rules.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Words of everyday blocklists and of ordinary sites, from general knowledge; no table was looked at for them.
BAD_WORDS = (
    "casino", "poker", "jackpot", "betting", "bets", "lottery", "roulette", "slots", "pills", "viagra", "pharmacy", "adult", "xxx", "porn", "escort",
    "sexcam", "webcams", "spam", "phishing", "malware", "trojan", "keygen", "warez", "torrent", "cracks", "ads", "adserver", "popunder", "tracker",
    "clickbait", "payday", "loans", "replica", "dating",
)
GOOD_WORDS = (
    "news", "blog", "docs", "wiki", "library", "museum", "garden", "science", "school", "college", "weather", "recipes", "music", "history", "travel",
    "health", "books", "physics", "market", "council", "kitchen", "football", "university", "research", "hospital", "gallery", "archive", "journal",
    "politics", "culture", "nature", "cooking", "chess", "astronomy", "railway", "forum", "maps", "theatre",
)
#: Addresses that sites of either kind have, and those that one kind has more often.
_SITES = ("{w}.com", "www.{w}.net", "{w}.org")
_BAD_SITES = ("best-{w}24.xyz", "www.{w}-online.top")
_GOOD_SITES = ("www.{w}.edu", "{w}.city.gov")
_PATHS = ("/en/{n}", "/de/{n}.html", "/es/{n}/", "/fr/{n}", "/")


def training_table(spark: SparkSession, bad=BAD_WORDS, good=GOOD_WORDS) -> DataFrame:
    """``(url, label)``: label 1 is to be blocked. A few hundred rows, five for each word."""
    rows = []
    for label, words, own in ((1, bad, _BAD_SITES), (0, good, _GOOD_SITES)):
        for i, w in enumerate(words):
            for j, site in enumerate(_SITES + own):
                rows.append(("https://" + site.format(w=w) + _PATHS[(i + j) % len(_PATHS)].format(n=17 * i + j), label))
    return spark.createDataFrame(rows, "url string, label int")


def _after_scheme(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + 3, F.length(url))


def host_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def with_parts(rows: DataFrame, url_col: str) -> DataFrame:
    """Adds ``host`` and ``path``; of a null or one without ``://`` both are empty."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    return rows.withColumns({"host": host_of(url), "path": path_of(url)})


def places(dim: int = DIM, gram: int = GRAM) -> Column:
    """Hashed places of the distinct n-grams of ``host`` and ``path``, each between markers."""

    def grams(part: str, mark: str) -> str:
        return f"transform(sequence(1, greatest(length({part}) + 2 - {gram} + 1, 1)), i -> concat('{mark}', substring(concat('^', {part}, '$'), i, {gram})))"

    return F.expr(f"array_distinct(transform(concat({grams('host', 'h')}, {grams('path', 'p')}), g -> cast(pmod(xxhash64(g), {dim}) as int)))")


def train(labelled: DataFrame, dim: int = DIM, gram: int = GRAM, url_col: str = "url", label_col: str = "label") -> tuple[list[float], float]:
    """Weights and intercept. Rows without a label are left out; with one class only the model is that class."""
    rows = with_parts(labelled.where(F.col(label_col).isNotNull()).select(F.col(url_col).alias("url"), F.col(label_col).cast("double").alias("label")), "url").withColumn("_at", places(dim, gram))
    dense = F.expr(f"transform(sequence(0, {dim - 1}), i -> if(array_contains(_at, i), 1D, 0D))")
    if rows.limit(1).count() == 0:
        return [0.0] * dim, -1.0
    model = LogisticRegression(regParam=0.003, maxIter=100, standardization=False).fit(rows.select(array_to_vector(dense).alias("features"), "label"))
    return [float(x) for x in model.coefficients.toArray()], float(model.intercept)


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url", dim: int = DIM, gram: int = GRAM) -> DataFrame:
    """Per row of ``pages``: ``page_id, host, path, rule, verdict`` and the model's ``score``.

    A rule fits its host and all subdomains of it where the path starts with the rule's; the longest fitting rule decides. Without
    one the model does: block from ``threshold`` on. Repeated rows and null ids are kept; only id and url are read. Rules are a
    bounded list (``MAX_RULES``), looked up by the host's own suffixes and not one by one. Of rules of the same length that fit, the one
    with the greater text decides, and of the same rule given twice with other verdicts ``block``. An empty table gives an empty result.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES}")
    weights, intercept = train(labelled, dim, gram)
    table_ = json.dumps({h: [{"path": p, "verdict": v} for x, p, v in rules if x == h] for h in {r[0] for r in rules}})
    rows = with_parts(pages.select(named(id_col).alias("page_id"), named(url_col).alias("_url")), "_url")
    rows = rows.withColumn("_rules", F.from_json(F.lit(table_), "map<string,array<struct<path:string,verdict:string>>>"))
    names = "transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, size(split(host, '[.]'))), '.'))"
    fitting = f"flatten(transform({names}, h -> transform(filter(coalesce(_rules[h], array()), r -> startswith(path, r.path)), r -> named_struct('n', length(h) + length(r.path), 'rule', concat(h, r.path), 'verdict', r.verdict))))"
    rows = rows.withColumn("_rule", F.array_max(F.expr(fitting)))
    rows = rows.withColumn("_w", F.from_json(F.lit(json.dumps(weights)), "array<double>")).withColumn("_at", places(dim, gram))
    logit = F.expr(f"{intercept!r}D + aggregate(_at, 0D, (a, i) -> a + _w[i])")
    score = 1 / (1 + F.exp(-logit))
    return rows.withColumn("score", score).select(
        "page_id",
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"),
        "score",
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), training_table(spark))
