"""Operator 10 [native]: URL rules, then gradient-boosted trees on lexical features, all as DataFrame expressions.

Allow and block rules (host, path prefix; a rule fits its host and all subdomains, the longest rule wins) come first.
Every other URL is judged by boosted trees, which learn from the labelled URLs alone: those that a rule labels. Each level of
a tree is one aggregation of gradient histograms by (leaf, feature, bin) over a bounded sample, of which the driver sees
only the histograms. Scoring is one expression.

Suffix statistics, and those of the path's first part, are counted over all rows: a suffix's share of them, and how many of
its labelled ones are blocked. For a URL that the trees learn from, the latter leaves out all URLs of its own fold, so that no label is its own evidence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.lineage import Shelf, small_side

#: Fixed rules of the page tables: verdict and rule.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

#: Distinct labelled URLs that the trees learn from at most, chosen by hash; each weighs as much as its rows.
SAMPLE = 20_000
#: Folds of the labelled URLs, by the CRC of the URL.
FOLDS = 5
TREES = 10
DEPTH = 3
RATE = 0.4
#: A leaf's second-order regularisation, and the least second-order sum of a side of a split.
LAMBDA = 1.0
LEAST_HESSIAN = 0.25
#: A URL is blocked from this score on.
BLOCK_SCORE = 0.5

_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Upper bounds of each feature's bins but the last.
BINS = {
    "f_length": (20, 25, 30, 35, 40, 45, 50, 60, 80, 120),
    "f_host_length": (8, 12, 15, 18, 20, 22, 24, 26, 30, 40),
    "f_depth": (1, 2, 3, 4, 6, 8),
    "f_labels": (1, 2, 3, 4, 5),
    "f_digit_ratio": (0.0, 0.05, 0.08, 0.1, 0.13, 0.16, 0.2, 0.3),
    "f_entropy": (3.0, 3.4, 3.6, 3.8, 4.0, 4.1, 4.2, 4.3, 4.4, 4.6, 5.0),
    "f_host_entropy": (2.0, 2.4, 2.6, 2.8, 3.0, 3.2, 3.4, 3.6, 3.8, 4.0),
    "f_params": (0, 1, 2, 3),
    "f_hyphens": (0, 1, 2, 3),
    "f_has_fragment": (0,),
    "f_path_suffix": (0, 1),
    "f_suffix_rate": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95),
    "f_suffix_share": (0.0001, 0.001, 0.01, 0.03, 0.1, 0.3),
    "f_head_rate": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95),
    "f_head_share": (0.0001, 0.001, 0.01, 0.03, 0.1, 0.3),
}


def host_of(url: Column) -> Column:
    """After the first ://, up to /, ?, # or the end, A-Z in lower case; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), *_LOWER)


def path_of(url: Column) -> Column:
    """After the host, up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null. Among rules of one length the first in order of the text wins."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def verdict_of(rule: Column, rules=RULES) -> Column:
    out = F.lit(None).cast("string")
    for verdict, text in rules:
        out = F.when(rule == text, F.lit(verdict)).otherwise(out)
    return out


def suffix_of(host: Column) -> Column:
    """The host's last label: what suffix statistics are kept for."""
    return F.element_at(F.split(host, r"\."), -1)


def head_of(path: Column) -> Column:
    """The path's first part."""
    return F.regexp_extract(path, "^/*([^/]*)", 1)


#: Keys of the statistics.
KEYS = ("suffix", "head")


def entropy(text: Column) -> Column:
    """Of the text's characters, in bits."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    share = lambda c: (F.length(text) - F.length(F.replace(text, c))) / n
    return F.aggregate(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features of one URL."""
    text = F.coalesce(url, F.lit(""))
    size = F.greatest(F.length(text), F.lit(1))
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    return {
        "f_length": F.length(text).cast("double"),
        "f_host_length": F.length(host).cast("double"),
        "f_depth": F.size(F.filter(F.split(path, "/"), lambda p: p != "")).cast("double"),
        "f_labels": F.size(F.split(host, r"\.")).cast("double"),
        "f_digit_ratio": F.length(F.regexp_replace(text, "[^0-9]", "")) / size,
        "f_entropy": entropy(text),
        "f_host_entropy": entropy(host),
        "f_params": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))).cast("double"),
        "f_hyphens": (F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit("")))).cast("double"),
        "f_has_fragment": F.when(text.contains("#"), 1.0).otherwise(0.0),
        "f_path_suffix": F.when(path.endswith("/"), 0.0).when(path.rlike(r"\.[a-z]+$"), 2.0).otherwise(1.0),
    }


def _bin(name: str) -> Column:
    """The bin's number: how many bounds lie under the value."""
    return reduce(lambda a, b: a + b, [(F.col(name) > bound).cast("int") for bound in BINS[name]])


def _tree(nodes: dict, at: str = "") -> Column:
    """A tree as nested conditions on bins; nodes: path of L and R to (feature, bin) or a leaf's value."""
    node = nodes[at]
    if not isinstance(node, tuple):
        return F.lit(float(node))
    return F.when(F.col(node[0]) <= node[1], _tree(nodes, at + "L")).otherwise(_tree(nodes, at + "R"))


def _leaf(nodes: dict, at: str = "") -> Column:
    """The path of the leaf so far that a row falls into."""
    node = nodes.get(at)
    if not isinstance(node, tuple):
        return F.lit(at)
    return F.when(F.col(node[0]) <= node[1], _leaf(nodes, at + "L")).otherwise(_leaf(nodes, at + "R"))


def _probability(margin: Column) -> Column:
    return 1 / (1 + F.exp(-margin))


def boost(rows: DataFrame, features: list[str], label: str, weight: str, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> tuple[float, list[dict]]:
    """Gradient boosting of the logistic loss on binned features: the starting margin and the trees.

    rows should be stored and small. Each level is one aggregation; the driver reads a histogram of at most
    2**depth leaves x features x bins.
    """
    from math import log

    total = rows.agg(F.sum(F.col(weight)), F.sum(F.col(weight) * F.col(label))).first()
    if not total[0] or not total[1] or total[1] == total[0]:
        return (-20.0 if not total[0] or not total[1] else 20.0), []
    start = log(total[1] / (total[0] - total[1]))
    forest: list[dict] = []
    margin = F.lit(start)
    for _ in range(trees):
        nodes: dict = {}
        p = _probability(margin)
        steps = rows.select(*features, ((p - F.col(label)) * F.col(weight)).alias("g"), (p * (1 - p) * F.col(weight)).alias("h"))
        open_ = {""}
        for level in range(depth):
            cells = F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(f).alias("b")) for k, f in enumerate(features)]))
            table = steps.select(_leaf(nodes).alias("leaf"), "g", "h", cells.alias("c")).groupBy("leaf", "c.f", "c.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            cells_of: dict[str, dict[int, list]] = {}
            for r in table:
                cells_of.setdefault(r["leaf"], {}).setdefault(r["f"], []).append((r["b"], r["g"], r["h"]))
            nxt, value = set(), lambda g, h: round(-rate * g / (h + LAMBDA), 6)
            for leaf in sorted(open_):
                by = cells_of.get(leaf, {})
                if not by:
                    nodes[leaf] = 0.0
                    continue
                g, h = sum(x[1] for x in by[0]), sum(x[2] for x in by[0])
                best = (1e-6, None, 0.0, 0.0)
                for f in sorted(by):
                    lg = lh = 0.0
                    for b, cg, ch in sorted(by[f])[:-1]:
                        lg, lh = lg + cg, lh + ch
                        if min(lh, h - lh) < LEAST_HESSIAN:
                            continue
                        gain = lg * lg / (lh + LAMBDA) + (g - lg) ** 2 / (h - lh + LAMBDA) - g * g / (h + LAMBDA)
                        if gain > best[0] + 1e-9:
                            best = (gain, (features[f], b), lg, lh)
                if best[1] is None:
                    nodes[leaf] = value(g, h)
                    continue
                nodes[leaf] = best[1]
                if level < depth - 1:
                    nxt |= {leaf + "L", leaf + "R"}
                else:  # the sums of both sides are known from the histogram
                    nodes[leaf + "L"], nodes[leaf + "R"] = value(best[2], best[3]), value(g - best[2], h - best[3])
            open_ = nxt
            if not open_:
                break
        forest.append(nodes)
        margin = margin + _tree(nodes)
    return start, forest


def with_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages (url, ..) with host, path, rule, ruling (the rule's verdict), suffix, head and fold."""
    url = F.col("url")
    ruled = pages.withColumns({"host": host_of(url), "path": path_of(url)}).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    return ruled.withColumns({"ruling": verdict_of(F.col("rule"), rules), "suffix": suffix_of(F.col("host")), "head": head_of(F.col("path")), "fold": F.crc32(F.coalesce(url, F.lit("")).cast("binary")) % FOLDS})


class Judge:
    """Suffix statistics and trees learned from the labelled URLs of a table. without: a fold, without_rule: a rule whose URLs nothing
    is learned from."""

    def __init__(self, pages: DataFrame, rules=RULES, sample: int = SAMPLE, without: int | None = None, without_rule: str | None = None):
        """pages: (url). Without labelled URLs of both kinds the trees give the only label there is, or allow."""
        shelf = Shelf(pages.sparkSession)
        # each URL once, weighing as much as its rows
        self.distinct = shelf.put(with_rules(shelf.put(pages.groupBy("url").agg(F.count("*").alias("times"))), rules).withColumn("label", (F.coalesce("ruling", F.lit("")) == "block").cast("int")))
        learned = F.col("rule").isNotNull() & (F.lit(True) if without is None else F.col("fold") != without)
        if without_rule is not None:
            learned = learned & (F.col("rule") != without_rule)
        known = F.when(learned, F.col("times")).otherwise(0)
        blocked = known * F.col("label")
        by_fold = [F.sum(F.when(F.col("fold") == k, c).otherwise(0)).alias(f"{n}{k}") for k in range(FOLDS) for n, c in (("known", known), ("blocked", blocked))]
        total = self.distinct.agg(F.sum("times")).first()[0] or 1
        self.statistics = {}
        for key in KEYS:  # of all rows
            counts = shelf.put(self.distinct.groupBy(key).agg((F.sum("times") / F.lit(total)).alias(f"f_{key}_share"), F.sum(known).alias("known"), F.sum(blocked).alias("blocked"), *by_fold))
            self.statistics[key] = small_side(counts)
        # a bounded sample by hash of the URL, for growing the trees alone
        examples = self.distinct.where(learned).orderBy(F.xxhash64("url"), "url").limit(sample)
        self.features = [f"b{f[1:]}" for f in BINS]
        training = shelf.put(self.featured(examples, own_fold=True).groupBy(*self.features, "label").agg(F.sum("times").cast("double").alias("weight")).coalesce(1))
        self.start, self.forest = boost(training, self.features, "label", "weight")
        self.margin = reduce(lambda a, b: a + b, [_tree(t) for t in self.forest], F.lit(self.start))

    def featured(self, df: DataFrame, own_fold: bool = False) -> DataFrame:
        """df (see with_rules) with its binned features; own_fold: rates of the statistics leave out the row's fold."""
        less = lambda n: F.element_at(F.array(*[F.col(f"{n}{k}") for k in range(FOLDS)]), F.col("fold").cast("int") + 1) if own_fold else F.lit(0)
        rate = (F.coalesce(F.col("blocked") - less("blocked"), F.lit(0)) + 1) / (F.coalesce(F.col("known") - less("known"), F.lit(0)) + 2)
        for key, counts in self.statistics.items():
            joined = df.join(counts, key, "left").withColumns({f"f_{key}_rate": rate, f"f_{key}_share": F.coalesce(f"f_{key}_share", F.lit(0.0))})
            df = joined.drop(*[c for c in counts.columns if c not in (key, f"f_{key}_share")])
        raw = df.withColumns(lexical_features(F.col("url"), F.col("host"), F.col("path")))
        return raw.withColumns({f"b{f[1:]}": _bin(f) for f in BINS}).drop(*BINS)

    def scored(self, df: DataFrame) -> DataFrame:
        """df (see with_rules) with the trees' score for every row, also of those that a rule decides."""
        return self.featured(df).withColumn("score", _probability(self.margin)).drop(*self.features)


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (of the trees; null where a rule decides).

    Null, empty and malformed URLs have an empty host and path, fit no rule and are judged like others by their features;
    very long ones are read whole. Of rules of one length the first in order of the text wins. Repeated rows stay and get
    one verdict; null ids stay; of no pages there are no verdicts; other columns of pages are not read.
    """
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    judge = Judge(base.select("url"), rules, sample)
    scored = judge.scored(with_rules(base, rules)).withColumn("score", F.when(F.col("rule").isNull(), F.col("score")))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruling", F.when(F.col("score") >= BLOCK_SCORE, "block").otherwise("allow")).alias("verdict"), "score")


def held_out_counts(pages: DataFrame, url_col: str = "url", rules=RULES, fold: int = 0) -> DataFrame:
    """(ruling, verdict, n) of the distinct labelled URLs of a fold, judged by trees that have learned from the other folds alone. Null
    URLs fit no rule and are not counted, repeated ones once, long ones whole; without labelled URLs there are no rows."""
    judge = Judge(pages.select(F.col(url_col).cast("string").alias("url")), rules, without=fold)
    own = judge.scored(judge.distinct.where((F.col("fold") == fold) & F.col("rule").isNotNull()))
    return own.groupBy("ruling", F.when(F.col("score") >= BLOCK_SCORE, "block").otherwise("allow").alias("verdict")).agg(F.count("*").alias("n"))


def held_out_rule_counts(pages: DataFrame, rule: str, url_col: str = "url", rules=RULES) -> DataFrame:
    """(ruling, verdict, n) of the distinct URLs of one rule, judged by trees that have seen no URL of it: how far the trees go beyond
    the rules that they learn from. A rule is a place and a verdict, so trees that know neither can only guess from its
    neighbours; this is what to expect of unruled URLs, not the figure of held_out_counts."""
    judge = Judge(pages.select(F.col(url_col).cast("string").alias("url")), rules, without_rule=rule)
    own = judge.scored(judge.distinct.where(F.col("rule") == rule))
    return own.groupBy("ruling", F.when(F.col("score") >= BLOCK_SCORE, "block").otherwise("allow").alias("verdict")).agg(F.count("*").alias("n"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
