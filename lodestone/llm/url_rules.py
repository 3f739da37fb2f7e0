"""URL filters: association rules (DataFrame functions and Spark's FP-growth only).

A URL becomes a set of tokens: top-level domain, registered domain, full host, every label of the host, every path
segment with its place, the extension and every query key, with digits as #. FP-growth mines combinations of
tokens with each label, and with `clean` for URLs without one; rules `tokens -> label` stay if their support is enough and their confidence
is above the label's base rate by MIN_GAIN of what the base rate leaves. As thousands of combinations are looked at, some of them
pass by chance; the share of such false rules is held to MAX_FALSE (Benjamini and Hochberg): a rule's chance is bounded by Chernoff's
bound of its count at the base rate, and the limit on it is set by how many rules pass it, out of all frequent combinations. No rule at all is a
right result where labels do not depend on URLs. Rules are matched by an inverted index: each rule is filed under its
rarest token, a URL's tokens look rules up there, and the rest of the rule is verified on the set.

The hand-written rules (host and path) come first: the longest that fits decides; of the mined rules the one with the
highest confidence decides the rest (then the highest support, then a label to block), and what no rule fits is allowed.

Scale: mining sees distinct labelled URLs, so a URL that holds a third of the rows counts once. Before it, tokens under
the support limit go (no itemset with them is frequent), and tokens that stand in the same URLs become one item (no count
changes), so a long fixed path is one item and not all its subsets. What is left to grow with the length of URLs are frequent
combinations of tokens that occur independently; the support limit bounds them. The index is looked up once for each distinct
token set; the answers are written, so that their size is known and the join back by set can be split where a set is hot.

Defined results: a null URL, or one without ://, has an empty host and path, no tokens, no rule and
the verdict allow; repeated rows and ties are judged alike (longest rule, then the smaller string); very long URLs are
read whole; a null label counts as not given; without labels nothing is mined and all that no rule blocks is allowed;
extra columns stay out; empty tables give empty tables.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common

#: verdict, host and path prefix
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LABEL, CLEAN = "label=", "clean"
#: Mined rules need this share of labelled URLs and this many of them (rows with the label), this part of the way from the
#: label's base rate to 1 as confidence, and at most this share of them may be expected to be chance findings.
MIN_SUPPORT, MIN_ROWS, MIN_GAIN, MAX_FALSE = 0.001, 5, 0.15, 0.05
#: Chances of rules are counted in steps of this many natural logarithms, the last step open.
STEP, STEPS = 0.25, 400


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _none() -> Column:
    return F.array().cast("array<string>")


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL."""
    h, p = host(url), path(url)
    labels = F.filter(F.split(h, r"\."), lambda x: x != "")
    plain = lambda c: F.regexp_replace(F.translate(c, UPPER, LOWER), "[0-9]+", "#")
    segments = F.filter(F.split(p, "/"), lambda x: x != "")
    stem = F.transform(segments, lambda x: plain(F.regexp_replace(x, r"\.[A-Za-z0-9]{1,5}$", "")))
    extension = F.regexp_extract(p, r"\.([A-Za-z0-9]{1,5})$", 1)
    keys = F.array_distinct(F.regexp_extract_all(_rest(url), F.lit(r"[?&]([^=&#]+)"), 1))
    found = F.concat(
        F.array(F.concat(F.lit("tld="), F.element_at(labels, -1)), F.concat(F.lit("domain="), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")), F.concat(F.lit("host="), h)),
        F.transform(labels, lambda x: F.concat(F.lit("part="), x)),
        F.transform(stem, lambda x, i: F.concat(F.lit("path"), i, F.lit("="), x)),
        F.when(extension != "", F.array(F.concat(F.lit("ext="), extension))).otherwise(_none()),
        F.transform(keys, lambda x: F.concat(F.lit("key="), plain(x))),
    )
    return F.when(F.size(labels) == 0, _none()).otherwise(F.array_sort(F.array_distinct(found)))


def mine(labelled: DataFrame, url_col: str = "url", label_cols: tuple[str, ...] = ("block",), min_support: float = MIN_SUPPORT, min_rows: int = MIN_ROWS, min_gain: float = MIN_GAIN, max_false: float = MAX_FALSE) -> DataFrame:
    """labelled: a URL and a boolean for each label. Rules as rule_tokens (array), label, confidence, support (rows with
    the label) and key, the rarest token. A URL has the labels of all its rows."""
    spark = labelled.sparkSession
    known = F.coalesce(*(F.col(c) for c in label_cols)).isNotNull()
    rows = labelled.where(labelled[url_col].isNotNull() & known).groupBy(labelled[url_col].alias("u")).agg(*(F.max(F.coalesce(F.col(c), F.lit(False))).alias(c) for c in label_cols))
    given = F.filter(F.array(*(F.when(F.col(c), F.lit(LABEL + c)) for c in label_cols)), lambda x: x.isNotNull())
    given = F.when(F.size(given) == 0, F.array(F.lit(LABEL + CLEAN))).otherwise(given)
    sets = rows.select(F.xxhash64("u").alias("id"), F.xxhash64(F.lit(1), "u").alias("id2"), tokens(F.col("u")).alias("tokens"), given.alias("given")).where(F.size("tokens") > 0)
    sets = common.staged(sets, "url-sets")
    n = sets.count()
    if not n:
        return spark.createDataFrame([], "rule_tokens array<string>, label string, confidence double, support long, key string")
    least = max(min_support, min_rows / n)
    # frequent tokens; those of the same URLs become one item, named by the first of them
    each = sets.select("id", "id2", F.explode("tokens").alias("token"))
    frequent = each.groupBy("token").agg(F.count("*").alias("freq"), F.bit_xor("id").alias("x"), F.bit_xor("id2").alias("y")).where(F.col("freq") >= min_rows)
    items = frequent.groupBy("freq", "x", "y").agg(F.min("token").alias("item"), F.sort_array(F.collect_set("token")).alias("members"))
    items = common.staged(items.select("item", "freq", "members"), "url-items")
    held = each.join(items.select(F.col("item").alias("token")), "token").groupBy("id", "id2").agg(F.collect_set("token").alias("held"))
    sets = sets.join(held, ["id", "id2"], "left").select(F.concat(F.coalesce("held", _none()), "given").alias("items"))
    sets = common.staged(sets.where(F.size("items") > 0), "url-items-of-sets")
    labels = sets.select(F.explode("items").alias("label")).where(F.startswith("label", F.lit(LABEL))).groupBy("label").count()
    base = {r["label"]: r["count"] / n for r in labels.collect()}  # one row for each label column
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least * n / max(sets.count(), 1)), minConfidence=0.0).fit(sets)
    tried = model.freqItemsets.where(~F.exists("items", lambda x: F.startswith(x, F.lit(LABEL)))).count() * len(base)
    rules = model.associationRules
    rules = rules.where((F.size("consequent") == 1) & F.startswith(F.col("consequent")[0], F.lit(LABEL)) & ~F.exists("antecedent", lambda x: F.startswith(x, F.lit(LABEL))))
    rate = F.lit(None).cast("double")
    for label, share in base.items():
        rate = F.when(F.col("consequent")[0] == label, F.lit(share)).otherwise(rate)
    rules = rules.select("antecedent", F.col("consequent")[0].alias("label"), "confidence", F.round(F.col("support") * sets.count()).cast("long").alias("support"), rate.alias("rate"))
    of = F.col("support") / F.col("confidence")
    enough = (F.col("support") >= F.greatest(F.lit(min_rows), F.lit(min_support * n))) & (F.col("confidence") >= F.col("rate") + min_gain * (1 - F.col("rate")))
    rules = common.staged(rules.withColumn("step", chance_steps(F.col("confidence"), F.col("rate"), of)), "url-candidates")
    rules = rules.where(enough & (F.col("step") >= least_step(rules, tried, max_false)))
    each = rules.select("*", F.explode("antecedent").alias("item")).join(items, "item")
    rules = each.groupBy("antecedent", "label", "confidence", "support").agg(F.sort_array(F.flatten(F.collect_list("members"))).alias("rule_tokens"), F.min(F.struct("freq", "item"))["item"].alias("key"))
    return common.staged(rules.select("rule_tokens", F.expr(f"substring(label, {len(LABEL) + 1})").alias("label"), "confidence", "support", "key"), "url-rules")


def chance_steps(share: Column, rate: Column, n: Column) -> Column:
    """Steps of -ln of Chernoff's bound on the chance that n rows at `rate` have `share` of the label, rounded down, STEPS at most."""
    part = lambda p, q: F.when(p > 0, p * F.log(p / q)).otherwise(0.0)
    far = n * (part(share, rate) + part(1 - share, 1 - rate))
    return F.when((share > rate) & (rate < 1), F.least(F.floor(far / STEP), F.lit(STEPS))).otherwise(0).cast("int")


def least_step(rules: DataFrame, tried: int, max_false: float) -> int:
    """The lowest step at which chance would bring at most max_false of the rules that reach it. At most STEPS + 1 counts reach the driver."""
    counts = {r["step"]: r["count"] for r in rules.groupBy("step").count().collect()}
    passing, out = 0, STEPS + 1
    for step in sorted(counts, reverse=True):
        passing += counts[step]
        if tried * math.exp(-STEP * step) <= max_false * passing:
            out = step
    return out


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """sets: distinct arrays `tokens`. Those that hold all tokens of a rule, with the best rule's label and confidence and the number of rules."""
    hits = sets.select("tokens", F.explode("tokens").alias("key")).join(rules, "key")
    hits = hits.where(F.size(F.array_intersect("rule_tokens", "tokens")) == F.size("rule_tokens"))
    best = F.max(F.struct("confidence", "support", (F.col("label") != CLEAN).alias("block"), "label"))
    return hits.groupBy("tokens").agg(best.alias("best"), F.count("*").alias("n_rules")).select("tokens", F.col("best.label").alias("label"), F.col("best.confidence").alias("confidence"), "n_rules")


def _fits(h: Column, p: Column, rule: tuple[str, str, str]) -> Column:
    return ((h == rule[1]) | F.endswith(h, F.lit("." + rule[1]))) & F.startswith(p, F.lit(rule[2]))


def judge(pages: DataFrame, mined: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, and label and confidence of the best mined rule and n_rules, the mined rules that fit."""
    out = pages.select(pages[id_col].alias("page_id"), host(pages[url_col]).alias("host"), path(pages[url_col]).alias("path"), tokens(pages[url_col]).alias("tokens"))
    found = common.staged(match(out.select("tokens").distinct(), mined), "url-matches")
    rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # later ones, the longer, come out on top
        fits = _fits(F.col("host"), F.col("path"), r)
        rule, said = F.when(fits, r[1] + r[2]).otherwise(rule), F.when(fits, r[0]).otherwise(said)
    out = out.join(found, "tokens", "left")
    mined_verdict = F.when(F.col("label") != CLEAN, "block").otherwise("allow")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(said, mined_verdict).alias("verdict"), "label", "confidence", F.coalesce("n_rules", F.lit(0)).alias("n_rules"))


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Page URLs with the labels of the document that a page shows (the number that ends its path): low quality, toxic."""
    number = F.regexp_extract(path(pages["url"]), r"/([0-9]{1,18})(?:\.[A-Za-z0-9]+)?/?$", 1)
    shown = pages.select("url", number.alias("n")).select("url", F.expr("try_cast(n as bigint)").alias("doc_id"))
    said = labels.select("doc_id", (F.col("quality") == 0).alias("low"), (F.col("toxic") == 1).alias("toxic"))
    return shown.join(said, "doc_id").select("url", "low", "toxic")


def op7_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    mined = mine(labelled_pages(pages, common.table(spark, sf_dir, "labels")), label_cols=("low", "toxic"))
    return judge(pages, mined)


QUERIES = {"op7_association_rules": op7_association_rules}
ORACLES: dict[str, str] = {}
