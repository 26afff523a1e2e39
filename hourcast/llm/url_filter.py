"""URL filter: rules first, gradient-boosted trees for the rest (operator 10).

A rule names a host (with all its subdomains) and a path prefix; the longest
fitting rule decides. URLs that no rule fits are judged by boosted trees on
lexical features: lengths, depth, digit share, character entropy, parameter
counts, and block rates per host suffix (last label, last two labels), which
are those of all labelled rows. The trees learn from the distinct URLs that
rules label, at most ``max_train`` of them, chosen by a hash of the URL. All
of it is DataFrame expressions and Spark ML.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from hourcast.session import cut_lineage

#: (rule, verdict)
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
MAX_TRAIN = 20_000
TREES, DEPTH = 10, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(__u, instr(__u, '://') + 3)"))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__u, instr(__u, '://') + 3)"))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def split_urls(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """(id, url, host, path); a null URL or one without :// has neither."""
    src = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("__u"))
    return src.select("id", F.coalesce("__u", F.lit("")).alias("url"), host_of(F.col("__u")).alias("host"), path_of(F.col("__u")).alias("path"))


def with_rules(urls: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule and its verdict (null where none fits). The rules are a
    parameter list, so they become one expression; of rules of one length
    (they cannot fit the same URL unless equal) the first wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: len(r[0])):  # the longest is tried first, outermost
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return urls.withColumn("rule", rule).withColumn("ruled", verdict)


NUMBERS = ("url_len", "host_len", "path_len", "depth", "labels", "digit_share", "upper_share", "symbol_share", "entropy", "params", "query_len",
           "has_fragment", "extension_len", "secure", "last_digits", "first_segment_len", "suffix_rate", "site_rate")


def suffixed(urls: DataFrame) -> DataFrame:
    """Adds the last label of the host and its last two."""
    return urls.withColumns({"suffix": F.substring_index("host", ".", -1), "site": F.substring_index("host", ".", -2)})


def lexical(urls: DataFrame) -> DataFrame:
    """Lexical features of (url, host, path), as doubles."""
    u = F.col("url")
    n = F.greatest(F.length(u), F.lit(1))
    share = lambda pattern: F.length(F.regexp_replace(u, pattern, "")) / n
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    last = F.element_at(F.split("path", "/"), -1)
    chars = F.array_distinct(F.split(u, ""))
    p = lambda c: (F.length(u) - F.length(F.replace(u, c, F.lit("")))) / n
    entropy = F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda acc, c: acc - p(c) * F.log2(p(c)))
    cols = {
        "url_len": F.length(u), "host_len": F.length("host"), "path_len": F.length("path"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda s: s != "")), "labels": F.size(F.split("host", r"\.")),
        "digit_share": share("[^0-9]"), "upper_share": share("[^A-Z]"), "symbol_share": share("[A-Za-z0-9]"), "entropy": entropy,
        "params": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))), "query_len": F.length(query),
        "has_fragment": u.contains("#").cast("int"), "extension_len": F.length(F.regexp_extract(last, r"\.([A-Za-z0-9]{1,8})$", 1)),
        "secure": u.startswith("https:").cast("int"), "last_digits": F.length(F.regexp_replace(last, "[^0-9]", "")),
        "first_segment_len": F.length(F.regexp_extract("path", "^/([^/]*)", 1)),
    }
    out = suffixed(urls)
    return out.withColumns({k: v.cast("double") for k, v in cols.items()})


#: rows of a table of suffixes up to which it is broadcast
MAX_BROADCAST = 100_000


class Judge:
    """Suffix rates and trees fitted on rule-labelled URLs."""

    def __init__(self, ruled: DataFrame, max_train: int = MAX_TRAIN, seed: int = 7):
        pool = ruled.where("ruled is not null").select("url", "host", "path", (F.col("ruled") == "block").cast("double").alias("label"))
        # labels per suffix and site over all labelled rows
        site = suffixed(pool).groupBy("suffix", "site").agg(F.count("*").alias("site_n"), F.sum("label").alias("site_blocked"))
        self.site = cut_lineage(site)
        suffix = self.site.groupBy("suffix").agg(F.sum("site_n").alias("suffix_n"), F.sum("site_blocked").alias("suffix_blocked"))
        self.suffix = cut_lineage(suffix)
        self.few = self.site.count() <= MAX_BROADCAST
        rows, blocked = self.suffix.agg(F.sum("suffix_n"), F.sum("suffix_blocked")).first()
        rows = rows or 0
        self.model, self.rate = None, (blocked or 0.0) / max(rows, 1)
        own = pool.groupBy("url", "host", "path").agg(F.count("*").alias("own_n"), F.sum("label").alias("own_blocked"), F.max("label").alias("label"))
        sample = cut_lineage(lexical(own.orderBy(F.xxhash64("url"), "url").limit(max_train)))
        self.assembler = VectorAssembler(inputCols=list(NUMBERS), outputCol="features")
        if rows and 0 < blocked < rows:  # else there is nothing to tell apart
            self.model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=seed, labelCol="label").fit(
                self.assembler.transform(self._rated(sample)).select("features", "label"))

    def _rated(self, df: DataFrame) -> DataFrame:
        """Adds the block rates of suffix and site, each drawn towards the one
        above it. A training row's own labels (``own_n``, ``own_blocked``) are
        taken out, so that trees cannot read a label off its own rate."""
        small = F.broadcast if self.few else (lambda t: t)
        n, blocked = (F.col("own_n"), F.col("own_blocked")) if "own_n" in df.columns else (F.lit(0), F.lit(0.0))
        rate = lambda kind, above: F.coalesce(
            (F.col(f"{kind}_blocked") - blocked + 5 * above) / (F.col(f"{kind}_n") - n + 5), above)
        out = df.join(small(self.suffix), "suffix", "left").join(small(self.site.drop("suffix")), "site", "left")
        out = out.withColumn("suffix_rate", rate("suffix", F.lit(self.rate)))
        return out.withColumn("site_rate", rate("site", F.col("suffix_rate")))

    def block_probability(self, urls: DataFrame) -> DataFrame:
        """Adds p_block; without a model the share of blocked labels."""
        rated = self._rated(lexical(urls))
        if self.model is None:
            return rated.withColumn("p_block", F.lit(self.rate))
        return self.model.transform(self.assembler.transform(rated)).withColumn("p_block", vector_to_array("probability")[1])


def held_out_auc(pages: DataFrame, rules=RULES, max_train: int = MAX_TRAIN, folds: int = 5, url_col: str = "url", id_col: str = "page_id") -> float | None:
    """Area under the curve on labelled URLs of sites that the trees and rates
    never saw: a fold of the sites keeps its labels to itself. None if the
    fold holds labels of one kind only."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    ruled = with_rules(split_urls(pages, id_col, url_col), rules).where("ruled is not null")
    away = F.pmod(F.xxhash64(F.substring_index("host", ".", -2)), F.lit(folds)) == 0
    got = cut_lineage(Judge(ruled.where(~away), max_train).block_probability(ruled.where(away))
                      .select((F.col("ruled") == "block").cast("double").alias("label"), "p_block"))
    if got.select("label").distinct().count() < 2:
        return None
    return BinaryClassificationEvaluator(rawPredictionCol="p_block").evaluate(got)


def judge(pages: DataFrame, rules=RULES, max_train: int = MAX_TRAIN, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, p_block) per row.

    Null URLs and URLs without :// have an empty host and path, fit no rule
    and are judged by the trees. Repeated rows are judged each. Without any
    labelled URL, or with labels of one kind only, the rest takes the kind
    that labels say (allow if there are none). Other columns are not read.
    """
    ruled = with_rules(split_urls(pages, id_col, url_col), rules)
    got = Judge(ruled, max_train).block_probability(ruled)
    verdict = F.coalesce("ruled", F.when(F.col("p_block") > 0.5, "block").otherwise("allow"))
    return got.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "p_block")
