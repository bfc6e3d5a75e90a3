"""URL filter: block and allow rules, and gradient-boosted trees on lexical features for the urls without a rule.

Urls that a rule decides are the labelled urls; the trees learn from them what blocked urls look like (lengths, depth,
shares of digits, entropy, parameters, and how often urls of the same host suffix are blocked) and decide the others. For
an url that trains, suffix statistics leave out the fold of urls it is in, so its own label is not in its features. Both
labels weigh the same. All of it is DataFrame operations and spark.ml; nothing but features of the url itself is used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toroid.llm.common import LOWER, UPPER, join_on_hot_key, materialise


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("com", "/en/", "block"), Rule("example.com", "/en/7", "allow"), Rule("net", "/de/", "allow"), Rule("example.net", "/de/8", "block"), Rule("org", "/es/", "block"),
)
#: Different labelled urls that the trees are fitted to, at most (half of each label; the first ones by hash), and folds of urls.
TRAIN_ROWS = 50_000
FOLDS = 5
TREES, DEPTH = 20, 4
#: Host suffixes up to this number are broadcast (about 60 bytes each).
BROADCAST_SUFFIXES = 100_000
FEATURES = (
    "url_length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "path_digit_ratio", "entropy", "parameters", "query_length", "hyphens", "has_fragment", "is_https", "longest_segment",
    "suffix_rate", "suffix_urls", "domain_rate", "domain_urls",
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased) and path (from there up to `?`, `#`
    or the end); both empty where the url is null or has no `://`."""
    at = F.instr(F.coalesce(url, F.lit("")), F.lit("://"))
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits, as its text (`host` + `path`); null where none does. Ties go to the first."""
    found = F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.text)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        found = F.when(fits, F.lit(rule.text)).otherwise(found)
    return found


def lexical(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with the lexical features of the url; a null url counts as empty."""
    u = F.coalesce(F.col(url), F.lit(""))
    ratio = lambda c: F.try_divide(F.regexp_count(c, F.lit("[0-9]")), F.char_length(c))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    entropy = "aggregate(transform(array_distinct(split(_u, '')), c -> (char_length(_u) - char_length(replace(_u, c, ''))) / char_length(_u)), 0D, (a, p) -> a - p * log2(p))"
    out = pages.withColumn("_u", u).withColumns({
        "url_length": F.char_length(u), "host_length": F.char_length("host"), "path_length": F.char_length("path"), "depth": F.size(F.filter(F.split("path", "/"), lambda s: s != "")),
        "host_labels": F.size(F.split("host", "[.]")), "digit_ratio": F.coalesce(ratio(u), F.lit(0.0)), "path_digit_ratio": F.coalesce(ratio(F.col("path")), F.lit(0.0)),
        "entropy": F.when(u == "", 0.0).otherwise(F.expr(entropy)), "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))), "query_length": F.char_length(query),
        "hyphens": F.regexp_count(u, F.lit("-")), "has_fragment": F.contains(u, F.lit("#")).cast("int"), "is_https": F.startswith(F.lower(F.substring(u, 1, 6)), F.lit("https:")).cast("int"),
        "longest_segment": F.coalesce(F.array_max(F.transform(F.split("path", "/"), F.char_length)), F.lit(0)), "suffix": F.substring_index("host", ".", -1), "domain": F.substring_index("host", ".", -2),
    })
    return out.drop("_u")


def _fold(url: str = "url") -> Column:
    return F.pmod(F.xxhash64(F.col(url), F.lit(1)), F.lit(FOLDS)).cast("int")


def _rates(key: str, blocked: Column, labelled: Column) -> dict[str, Column]:
    """Smoothed share of blocked urls of a suffix, and logarithm of the number of labelled ones."""
    return {f"{key}_rate": (blocked + 1) / (labelled + 2), f"{key}_urls": F.log1p(labelled.cast("double"))}


def _counts(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.coalesce(F.sum("label"), F.lit(0.0)).alias("_blocked"), F.count("label").alias("_labelled"), F.count("*").alias("_rows"))


def _with_rates(rows: DataFrame, counts: DataFrame, key: str, total: int) -> DataFrame:
    """rows with the statistics of their suffix over all labelled urls. Few suffixes are broadcast, hot ones always."""
    small = counts.limit(BROADCAST_SUFFIXES + 1).count() <= BROADCAST_SUFFIXES
    joined = rows.join(F.broadcast(counts), key) if small else join_on_hot_key(rows, counts, [key], "_rows", total)
    return joined.withColumns(_rates(key, F.col("_blocked"), F.col("_labelled"))).drop("_blocked", "_labelled", "_rows")


def training_urls(marked: DataFrame, counts: dict[str, DataFrame], train_rows: int) -> DataFrame:
    """A bounded sample of different labelled urls, as many of each label where there are, with features and weight."""
    urls = marked.where("label is not null").dropDuplicates(["url"])
    halves = [urls.where(F.col("label") == k).orderBy(F.xxhash64("url"), "url").limit(train_rows // 2) for k in (0.0, 1.0)]
    rows = materialise(halves[0].unionByName(halves[1]).withColumn("_fold", _fold()))
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    for key, all_ in counts.items():
        # the sample is bounded, so it is the side that is broadcast
        own = _counts(marked.where("label is not null").withColumn("_fold", _fold()), key, "_fold").select(key, "_fold", F.col("_blocked").alias("_b"), F.col("_labelled").alias("_l"))
        rows = own.join(F.broadcast(rows), [key, "_fold"])
        rows = materialise(all_.join(F.broadcast(rows), key).withColumns(_rates(key, F.col("_blocked") - F.col("_b"), F.col("_labelled") - F.col("_l"))).drop("_b", "_l", "_blocked", "_labelled", "_rows"))
    weight = F.when(F.col("label") == 1, F.lit(1 / max(1, sizes.get(1.0, 0)))).otherwise(F.lit(1 / max(1, sizes.get(0.0, 0))))
    return rows.withColumn("weight", weight * sum(sizes.values()) / 2)


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """id, host, path, rule, verdict, and block_score (null where a rule decides or nothing was learned).

    verdict is the rule's, else `block` where the trees give blocking the larger chance. If the labelled urls are all of one
    kind, that kind is the verdict of the others; with none, they are allowed. Rows that repeat are judged each; a null
    url has empty host and path; urls of any length are read whole; of rules of one length that fit, the first decides;
    an empty table gives an empty result; no other column is read.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), path.alias("path"))
    verdicts = F.create_map(*[F.lit(x) for r in rules for x in (r.text, r.verdict)]) if rules else F.create_map().cast("map<string,string>")
    rows = rows.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("ruled", F.try_element_at(verdicts, F.col("rule")))
    marked = materialise(lexical(rows).withColumn("label", F.when(F.col("ruled").isNotNull(), (F.col("ruled") == "block").cast("double"))))
    labelled = marked.where("label is not null")
    kinds = [r["label"] for r in labelled.select("label").distinct().collect()]
    if len(kinds) < 2:
        other = F.lit("block" if kinds == [1.0] else "allow")
        return marked.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", other).alias("verdict"), F.lit(None).cast("double").alias("block_score"))
    total = marked.count()
    counts = {key: materialise(_counts(marked, key)) for key in ("suffix", "domain")}
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    train = materialise(assembler.transform(training_urls(marked, counts, train_rows)).select("label", "features", "weight"))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=42, featuresCol="features", labelCol="label", weightCol="weight").fit(train)
    ready = marked
    for key, all_ in counts.items():
        ready = _with_rates(ready, all_, key, total)
    ready = assembler.transform(ready)
    found = model.transform(ready)
    learned = F.when(F.col("prediction") == 1, "block").otherwise("allow")
    chance = F.try_element_at(_as_array("probability"), F.lit(2))
    return found.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"), F.when(F.col("ruled").isNull(), chance).alias("block_score"))


def _as_array(column: str) -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(F.col(column))
