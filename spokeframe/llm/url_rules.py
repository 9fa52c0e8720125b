"""URL filters: fixed host and path rules, then association rules mined from labels.

Labelled urls become sets of tokens (host and its parent domains, path words, file
ending, query keys) plus their label. Spark's FP-growth finds the combinations that
are frequent enough; those that meet a label often enough, and more often than the
label occurs at large, become rules. An inverted index from each rule's rarest token
finds the rules that may fit a url; a rule fits if the url has all of its tokens.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import column, free_name, kept, lower_ascii, read_table

#: (verdict, host, path) of the list; fixed values.
LISTED = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

#: A combination must hold in this share of the labelled urls, and meet its label in this share of those.
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.6
#: ... and that many times as often as labelled urls do at large.
MIN_LIFT = 1.2

LABEL = "label="


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed_rule(host: Column, path: Column, listed: tuple = LISTED) -> tuple[Column, Column]:
    """The longest rule of the list that fits, as text, and its verdict; NULL if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, domain, start in sorted(listed, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        rule = F.when(fits, F.lit(domain + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """The set of a url's tokens; empty for NULL or without ``://``."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    count = F.size(labels)
    domains = F.transform(
        F.sequence(F.lit(1), count), lambda i: F.concat(F.lit("host="), F.array_join(F.slice(labels, i, count), "."))
    )
    words = F.transform(
        F.filter(F.split(path, "/"), lambda p: (p != "") & ~p.rlike("^[0-9]+([.][a-z]+)?$")),
        lambda p: F.concat(F.lit("path="), p),
    )
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    keys = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p: F.concat(F.lit("query="), F.substring_index(p, "=", 1)),
    )
    some = F.concat(
        domains,
        words,
        F.when(ending != "", F.array(F.concat(F.lit("ending="), ending))).otherwise(F.array().cast("array<string>")),
        keys,
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(some))


def mine_rules(
    labelled: DataFrame,
    url_col: str = "url",
    label_col: str = "label",
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    min_lift: float = MIN_LIFT,
) -> DataFrame:
    """Rules from urls labelled ``allow`` or ``block``: items, verdict, confidence, support, anchor.

    Rows without url or label teach nothing; an empty table gives no rules. All labelled
    rows count. Rules may ask for any number of tokens; one is left out only if without one
    of its tokens it is a rule of the same verdict and at least the same confidence, which
    then fits wherever it fits and comes no later in :func:`judged`. ``anchor`` is the rarest
    of a rule's tokens.
    """
    baskets = (
        labelled.where(column(url_col).isNotNull() & column(label_col).isNotNull())
        .select(tokens(column(url_col)).alias("tokens"), F.concat(F.lit(LABEL), column(label_col)).alias("label"))
        .where(F.size("tokens") > 0)
        .select(F.array_append("tokens", F.col("label")).alias("items"))
    )
    baskets = kept(baskets, "baskets")
    total = baskets.count()
    spark = labelled.sparkSession
    if not total:
        return spark.createDataFrame(
            [], "items array<string>, verdict string, confidence double, support double, anchor string"
        )
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    sets = kept(model.freqItemsets, "itemsets")
    is_label = lambda x: x.startswith(LABEL)
    plain = sets.where(~F.exists("items", is_label)).select(F.array_sort("items").alias("items"), F.col("freq").alias("all"))
    with_label = sets.where(F.exists("items", is_label)).select(
        F.array_sort(F.filter("items", lambda x: ~is_label(x))).alias("items"),
        F.substring(F.filter("items", is_label)[0], len(LABEL) + 1, 1 << 20).alias("verdict"),
        F.col("freq").alias("both"),
    )
    at_large = with_label.where(F.size("items") == 0).select("verdict", (F.col("both") / total).alias("share"))
    strong = (
        with_label.where(F.size("items") > 0)
        .join(plain, "items")
        .join(at_large, "verdict")
        .withColumn("confidence", F.col("both") / F.col("all"))
        .where((F.col("confidence") >= min_confidence) & (F.col("confidence") >= min_lift * F.col("share")))
        .select("items", "verdict", "confidence", (F.col("both") / total).alias("support"))
    )
    rules = _needed(kept(strong, "strong"))
    single = plain.where(F.size("items") == 1).select(F.col("items")[0].alias("item"), "all")
    rarest = (
        rules.select("items", "verdict", F.explode("items").alias("item"))
        .join(single, "item")
        .groupBy("items", "verdict")
        .agg(F.min(F.struct("all", "item"))["item"].alias("anchor"))
    )
    return kept(rules.join(rarest, ["items", "verdict"]), "rules")


def _needed(rules: DataFrame) -> DataFrame:
    """Rules without those that a rule with one token less settles: it has no smaller support."""
    less = F.transform("items", lambda x: F.array_remove(F.col("items"), x))
    shorter = rules.select(F.col("items").alias("fewer"), "verdict", F.col("confidence").alias("at_least"))
    settled = (
        rules.where(F.size("items") > 1)
        .select("items", "verdict", "confidence", F.explode(less).alias("fewer"))
        .join(shorter, ["fewer", "verdict"])
        .where("at_least >= confidence")
        .select("items", "verdict")
    )
    return rules.join(settled, ["items", "verdict"], "left_anti")


def judged(
    pages: DataFrame, rules: DataFrame, url_col: str = "url", listed: tuple = LISTED, default: str = "allow"
) -> DataFrame:
    """``pages`` with host, path, rule and verdict; every row stays, repeated rows too.

    The longest rule of the list that fits decides; else the mined rule with the highest
    confidence (then support, then ``block``) among those that fit; else ``default``. A
    url that is NULL or has no ``://`` has an empty host and path and gets ``default``.
    New columns are lengthened where the table has such names already.
    """
    host, path, rule, verdict = (free_name(pages, n) for n in ("host", "path", "rule", "verdict"))
    # The index: rules by anchor, as one map value; support and _needed() limit their number.
    entry = F.struct("items", "confidence", "support", "verdict")
    index = rules.groupBy("anchor").agg(F.collect_list(entry).alias("rules")).agg(
        F.map_from_entries(F.collect_list(F.struct("anchor", "rules"))).alias("index")
    )
    found = tokens(column(url_col))
    all_columns = [column(c) for c in pages.columns]
    work, near, lookup = (free_name(pages, n) for n in ("tokens_of_url", "verdict_of_rules", "rule_index"))
    table = pages.select(
        *all_columns,
        host_of(column(url_col)).alias(host),
        path_of(column(url_col)).alias(path),
        found.alias(work),
        index.scalar().alias(lookup),
    )
    of_token = F.transform(F.col(work), lambda t: F.col(lookup)[t])
    candidates = F.flatten(F.filter(of_token, lambda r: r.isNotNull()))
    fitting = F.filter(candidates, lambda r: F.size(F.array_except(r["items"], F.col(work))) == 0)
    best = F.array_max(
        F.transform(fitting, lambda r: F.struct(r["confidence"], r["support"], r["verdict"].alias("verdict")))
    )
    named, decided = listed_rule(F.col(host), F.col(path), listed)
    return table.withColumn(near, best["verdict"]).select(
        *all_columns,
        host,
        path,
        named.alias(rule),
        F.coalesce(decided, F.col(near), F.lit(default)).alias(verdict),
    )


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Urls of pages whose path ends in the number of a labelled document: url, label.

    ``block`` if any label of that document says toxic or of low quality. Pages or labels
    without such a number teach nothing.
    """
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:[./][^/]*)?$", 1)
    urls = pages.select("url", F.when(number != "", number.cast("long")).alias("doc_id")).where("doc_id IS NOT NULL")
    bad = F.max((F.col("toxic") == 1) | (F.col("quality") == 0))
    verdicts = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(bad.alias("bad")).where("bad IS NOT NULL")
    return urls.join(verdicts, "doc_id").select("url", F.when(F.col("bad"), "block").otherwise("allow").alias("label"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    rules = mine_rules(labelled_urls(pages, read_table(spark, sf_dir, "labels")))
    return judged(pages, rules).select("page_id", "host", "path", "rule", "verdict")
