"""URL filters: rules first, gradient-boosted trees on lexical features for the rest.

Parsing, rules, features and scoring are built-in functions; the trees are Spark ML's, fitted on labelled URLs. Suffix
statistics (the smoothed share of blocked URLs per last host label) come from the labelled URLs as well.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import materialise

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


@dataclass(frozen=True)
class Params:
    trees: int = 20
    depth: int = 4
    step: float = 0.2
    rows: int = 20_000  # labelled URLs that the fit takes at most, about
    smoothing: float = 10.0
    suffixes: int = 1000  # with statistics of their own; the rest get the overall share
    seed: int = 11


def parsed(urls: DataFrame) -> DataFrame:
    """``urls`` with host and path, both empty where the url is null or has no ``://``."""
    url = F.coalesce(F.col("url"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.expr("substr(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    out = urls.withColumn("__rest", rest)
    raw = F.regexp_extract("__rest", r"^[^/?#]*", 0)
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract("__rest", r"(?s)^[^/?#]*([^?#]*)", 1)
    return out.withColumn("host", host).withColumn("path", path).drop("__rest")


def judged(rows: DataFrame, rules: tuple = RULES) -> DataFrame:
    """``rows`` (host, path) with rule and rule_verdict of the longest fitting rule, null where none fits."""

    def fits(host: str, path: str) -> Column:
        return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)

    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        rule = F.when(fits(host, path), F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits(host, path), F.lit(what)).otherwise(verdict)
    return rows.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def _entropy(s: Column) -> Column:
    n = F.length(s)
    share = F.transform(F.array_distinct(F.split(s, "")), lambda c: F.when(F.length(c) > 0, (n - F.length(F.replace(s, c, F.lit("")))) / n).otherwise(F.lit(0.0)))
    return F.when(n > 0, F.aggregate(share, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.log2(x)).otherwise(F.lit(0.0)))).otherwise(F.lit(0.0))


FEATURES = ["f_length", "f_host_length", "f_path_length", "f_depth", "f_labels", "f_digits", "f_host_digits", "f_host_hyphens", "f_entropy", "f_host_entropy", "f_parameters", "f_signs", "f_longest_digits", "f_secure", "f_suffix"]


def features(rows: DataFrame, suffix: Column) -> DataFrame:
    """``rows`` (url, host, path) with the lexical FEATURES as doubles; null urls count as empty."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")

    def many(s: Column, pattern: str) -> Column:
        return F.regexp_count(s, F.lit(pattern))

    def share(s: Column, pattern: str) -> Column:
        return many(s, pattern) / F.greatest(F.lit(1), F.length(s))

    values = [
        F.length(url), F.length(host), F.length(path), many(path, "/[^/]"), many(host, r"[^.]+"), share(path, "[0-9]"), share(host, "[0-9]"), many(host, "-"), _entropy(url), _entropy(host),
        many(F.regexp_extract(url, r"\?([^#]*)", 1), "[^&]+"), share(url, r"[^A-Za-z0-9/.:]"), F.array_max(F.transform(F.split(url, "[^0-9]+"), lambda x: F.length(x))), url.startswith("https:").cast("int"), suffix,
    ]
    return rows.withColumns({n: v.cast("double") for n, v in zip(FEATURES, values, strict=True)})


# Words that mark a host as junk where no labels are given.
JUNK = ("ads", "adult", "bets", "casino", "pills", "poker", "porn", "spam", "viagra", "xxx")


def word_labels(urls: DataFrame, junk: tuple[str, ...] = JUNK) -> DataFrame:
    """(url, label): 1 where a word of the host is in ``junk``, else 0. Null urls and those without a host have no label.

    Words are no features of the trees, which learn from these labels what such hosts look like otherwise.
    """
    rows = parsed(urls.select("url").where("url is not null")).where("host <> ''")
    return rows.select("url", F.arrays_overlap(F.split("host", "[^a-z]+"), F.array(*(F.lit(x) for x in junk))).cast("int").alias("label"))


# Shares of blocked and of clean example URLs that carry a mark; no mark is of one label alone.
MARKS = {"hyphen": (60, 15), "host_digits": (35, 10), "path_numbers": (50, 12), "parameters": (45, 12), "suffix": (40, 6)}


def example_labels(spark: SparkSession, n: int = 2000) -> DataFrame:
    """Labelled URLs (url, label 1 = block) made by a rule: every second one is blocked.

    Each carries, by hash and with the shares of ``MARKS``, a hyphen or digits in the host, long numbers in the path, many
    parameters or a rare suffix. Marks occur in clean URLs as well, so that only several together decide.
    """
    part = ["re", "ta", "lo", "mi", "sen", "dor", "kan", "vel", "pri", "nos", "tem", "gar", "ble", "sun", "fol"]
    syllables = F.array(*(F.lit(x) for x in part))

    def pick(salt: str, of: Column, k: int) -> Column:
        return F.element_at(of, (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(k)) + 1).cast("int"))

    def word(salt: str) -> Column:
        return F.concat(*(pick(salt + c, syllables, len(part)) for c in "abc"))

    def number(salt: str, k: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(k)).cast("string")

    def odds(salt: str, k: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(k)) == 0

    bad = F.col("id") % 2 == 1

    def marked(name: str) -> Column:
        blocked, clean = MARKS[name]
        return F.pmod(F.xxhash64("id", F.lit("mark " + name)), F.lit(100)) < F.when(bad, F.lit(blocked)).otherwise(F.lit(clean))

    def named(*suffixes: str) -> Column:
        return pick("suffix", F.array(*(F.lit(x) for x in suffixes)), len(suffixes))

    none = F.lit("")
    suffix = F.when(marked("suffix"), named("info", "biz", "top", "click")).otherwise(named("com", "org", "net", "edu"))
    host = F.concat(word("h"), F.when(marked("host_digits"), number("hd", 100000)).otherwise(none), F.when(marked("hyphen"), F.concat(F.lit("-"), word("i"))).otherwise(F.when(odds("two", 3), F.concat(F.lit("."), word("g"))).otherwise(none)))
    before = pick("www", F.array(*(F.lit(x) for x in ("", "www.", "m.", "blog."))), 4)
    path = F.concat(F.lit("/"), word("p"), F.lit("/"), F.when(marked("path_numbers"), F.concat(number("n1", 1 << 30), F.lit("/"), number("n2", 1 << 30))).otherwise(number("n3", 1000)))
    query = F.when(marked("parameters"), F.concat(F.lit("?a="), number("q", 1 << 30), F.lit("&b=1&c=2&d="), number("r", 1 << 30))).when(odds("query", 5), F.lit("?page=2")).otherwise(none)
    url = F.concat(F.when(odds("scheme", 3), F.lit("http://")).otherwise(F.lit("https://")), before, host, F.lit("."), suffix, path, query)
    return spark.range(0, n, 1, 1).select(url.alias("url"), bad.cast("int").alias("label"))


class UrlModel:
    def __init__(self, trees, suffix: dict[str, float], overall: float):
        self.trees, self.suffix, self.overall = trees, suffix, overall

    def suffix_column(self) -> Column:
        found = F.lit(self.overall)
        if self.suffix:
            table = F.create_map(*(F.lit(x) for kv in sorted(self.suffix.items()) for x in kv))
            found = F.coalesce(F.try_element_at(table, _suffix()), found)
        return found


def _suffix() -> Column:
    return F.regexp_extract("host", r"[^.]*$", 0)


def fit(labelled: DataFrame, p: Params = Params()) -> UrlModel | None:
    """Train on (url, label 0/1); None if there are no labelled URLs or only one label (then nothing is blocked).

    Of more than ``rows`` labelled URLs about so many are taken, by a hash of the URL; null urls and other labels are ignored.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = labelled.where("url is not null and label in (0, 1)")
    total = rows.agg(F.count("*").alias("n"), F.avg("label").alias("share")).first()
    if not total["n"] or total["share"] in (0.0, 1.0):
        return None
    draw = F.pmod(F.xxhash64("url"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = parsed(rows.where(draw < p.rows / total["n"]))
    by = rows.groupBy(_suffix().alias("s")).agg(F.count("*").alias("n"), F.sum("label").alias("bad")).orderBy(F.desc("n"), "s").limit(p.suffixes).collect()
    share = total["share"]
    model = UrlModel(None, {r["s"]: (r["bad"] + p.smoothing * share) / (r["n"] + p.smoothing) for r in by}, share)
    known = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(rows, model.suffix_column())).select("features", F.col("label").cast("double").alias("label"))
    trees = GBTClassifier(maxIter=p.trees, maxDepth=p.depth, stepSize=p.step, seed=p.seed)
    # The trees read their few rows many times: a small table, without the features' expressions.
    model.trees = trees.fit(materialise(known.coalesce(1), "url-features"))
    return model


def filter_urls(urls: DataFrame, model: UrlModel | None, rules: tuple = RULES) -> DataFrame:
    """``urls`` (url and other columns) with host, path, rule and verdict (``allow`` or ``block``), which replace columns of those names.

    A null url is judged as an empty one. Repeated rows get equal verdicts; an empty table gives no rows.
    """
    from pyspark.ml.feature import VectorAssembler

    rows = judged(parsed(urls.drop("host", "path", "rule", "rule_verdict", "verdict")), rules)
    if model is None:
        return rows.withColumn("verdict", F.coalesce("rule_verdict", F.lit("allow"))).drop("rule_verdict")
    scored = VectorAssembler(inputCols=FEATURES, outputCol="__features").transform(features(rows, model.suffix_column()))
    scored = model.trees.setFeaturesCol("__features").setPredictionCol("__prediction").setRawPredictionCol("__raw").setProbabilityCol("__probability").transform(scored)
    verdict = F.coalesce("rule_verdict", F.when(F.col("__prediction") > 0.5, "block").otherwise("allow"))
    return scored.withColumn("verdict", verdict).drop("rule_verdict", "__features", "__prediction", "__raw", "__probability", *FEATURES)
