"""Operator 1, URL filters by association rules, in DataFrame functions only.

URLs with a label are baskets of tokens (scheme, host suffixes, path words, file type,
query keys, fragment).  FP-growth finds the combinations that are frequent among the
allowed URLs and those that are frequent among the blocked ones, each by its own number
of URLs, so that the rarer label loses none.  Every combination's frequency among the
URLs of the other label is counted exactly.  Rules from tokens to a label are kept if
their support and confidence reach the minima and no rule on fewer tokens is as
confident.  The rules become an inverted index from tokens to rules.  A URL's tokens
look their rules up and a rule matches when all of its tokens did; the most confident
match decides.  Scoring is one narrow projection: no shuffle, no join, no Python.

Before mining, tokens below the minimum support and tokens of every URL are left out (no
rule with them says more than one without), and tokens that always come together
count as one; nothing else bounds a basket or the length of a rule.  How many rules there
can be is bounded by the minimum support, not by the number of URLs; so the index is
a literal of the plan.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import column_of, free_name, others, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed rules: (verdict, host, path).
HOST_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
VERDICTS = ("allow", "block")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://`` or for null."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"\A[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def fixed_rule(host: Column, path: Column, rules=HOST_RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    out = None
    for verdict, name, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:], r[0])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        value = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL; numbers alone are no tokens, so that they don't tell single pages apart."""
    return let(F.struct(host_of(url).alias("host"), path_of(url).alias("path")), lambda p: _tokens(url, p["host"], p["path"]))


def _tokens(url: Column, host: Column, path: Column) -> Column:
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda i: F.concat(F.lit("host="), F.array_join(F.slice(labels, -i, i), ".")))
    words = F.filter(F.split(F.translate(path, UPPER, LOWER), r"[/_.\-]+"), lambda x: (x != "") & ~x.rlike(r"\A[0-9]+\z"))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("key="), F.regexp_extract(x, r"\A[^=]*", 0)))
    scheme = F.array(F.concat(F.lit("scheme="), F.translate(F.regexp_extract(url, r"\A([A-Za-z][A-Za-z0-9+.\-]*)://", 1), UPPER, LOWER)))
    shape = F.array(
        F.when(path.endswith("/"), F.lit("end=slash")).when(path.rlike(r"\.[A-Za-z]{1,5}\z"), F.concat(F.lit("end="), F.translate(F.regexp_extract(path, r"\.([A-Za-z]{1,5})\z", 1), UPPER, LOWER))).otherwise(F.lit("end=bare")),
        F.when(F.locate("#", url) > 0, F.lit("has=fragment")).otherwise(F.lit("has=no fragment")),
    )
    every = F.concat(scheme, F.when(F.size(labels) > 0, suffixes).otherwise(F.array().cast("array<string>")), F.transform(words, lambda x: F.concat(F.lit("word="), x)), keys, shape)
    return F.when(url.isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(every))


def mine_rules(labelled: DataFrame, url: str = "url", label: str = "verdict", min_support: float = 0.005, min_confidence: float = 0.5, max_rows: int = 200_000) -> list[dict]:
    """Rules (tokens, verdict, confidence, support), best first, from rows with a label of ``allow`` or ``block``.

    Blocked URLs are rare; both labels count with equal total weight in a rule's
    confidence, so that a combination blocks when it is clearly commoner among blocked
    URLs.  ``min_support`` is a share of one label's URLs.  At most ``max_rows`` labelled
    rows are mined, picked by a hash of the URL.  Null URLs and other labels teach nothing;
    without both labels there is no rule.
    """
    rows = labelled.filter(F.col(label).isin(*VERDICTS) & F.col(url).isNotNull()).select(F.col(url).alias("u"), F.col(label).alias("v"))
    rows = rows.orderBy(F.xxhash64("u"), "u", "v").limit(max_rows)
    baskets = written(rows.select(F.xxhash64("u", "v", F.monotonically_increasing_id()).alias("row"), url_tokens(F.col("u")).alias("tokens"), "v"), "url-baskets")
    totals = {r["v"]: r["n"] for r in baskets.groupBy("v").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if len(totals) < 2:
        return []
    least = {v: max(1, math.ceil(min_support * totals[v])) for v in VERDICTS}
    per = F.create_map(*[F.lit(x) for v in VERDICTS for x in (v, least[v])])
    # tokens that are frequent with a label and not everywhere; those of the same rows have equal sums
    single = baskets.select("row", "v", F.explode("tokens").alias("token"))
    of_token = single.groupBy("token", "v").agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(row)").alias("x"), F.expr("bit_xor(xxhash64(row))").alias("y"))
    of_token = of_token.groupBy("token").agg(F.max(F.col("n") >= per[F.col("v")]).alias("frequent"), F.sum("n").alias("n"), F.expr("bit_xor(x)").alias("x"), F.expr("bit_xor(y)").alias("y"))
    useful = of_token.filter("frequent").filter(F.col("n") < sum(totals.values())).groupBy("n", "x", "y").agg(F.min("token").alias("token"))
    known = sorted(r["token"] for r in useful.select("token").collect())  # bounded by the minimum support
    if not known:
        return []
    few = F.array_intersect("tokens", F.array(*map(F.lit, known)))
    small = written(baskets.select("row", "v", F.array_sort(few).alias("tokens")), "url-tokens")
    counted: dict[tuple[str, ...], dict[str, int]] = {}
    for v in VERDICTS:
        own = small.filter((F.col("v") == v) & (F.size("tokens") > 0)).select("tokens")
        share = (least[v] - 0.5) / max(1, own.count())
        sets = FPGrowth(itemsCol="tokens", minSupport=min(1.0, share), minConfidence=1.0).fit(own).freqItemsets
        for r in sets.collect():  # bounded by the minimum support
            counted.setdefault(tuple(sorted(r["items"])), {})[v] = r["freq"]
    for v in VERDICTS:
        missing = [(i, list(t)) for i, t in enumerate(counted) if v not in counted[t]]
        names = list(counted)
        for r in _count_sets(small.filter(F.col("v") == v), missing).collect():  # a row for each combination at most
            counted[names[r["id"]]][v] = r["n"]
    found = []
    n = sum(totals.values())
    for tokens, seen in counted.items():
        a, b = (seen.get("allow", 0) + 1) / (totals["allow"] + 2), (seen.get("block", 0) + 1) / (totals["block"] + 2)
        times = sum(seen.values())
        confidence = max(a, b) / (a + b)
        # confidence of chance alone is one half; two deviations above it are asked for
        if confidence >= max(min_confidence, 0.5 + 1 / math.sqrt(min(times, 2 * min(totals.values())))):
            found.append({"tokens": list(tokens), "verdict": "block" if b > a else "allow", "confidence": confidence, "support": times / n})
    found.sort(key=lambda r: (-round(r["confidence"], 9), len(r["tokens"]), -r["support"], r["tokens"]))
    best: dict[tuple[str, ...], dict] = {}
    out = []
    for r in sorted(found, key=lambda r: len(r["tokens"])):
        t = r["tokens"]
        below = [best[s] for y in t if (s := tuple(x for x in t if x != y)) in best]
        top = {v: max((b[v] for b in below), default=0.0) for v in VERDICTS}
        if r["confidence"] > top[r["verdict"]]:
            out.append(r)
        # the best confidence on any part of these tokens
        best[tuple(t)] = {v: max(top[v], r["confidence"] if r["verdict"] == v else 0.0) for v in VERDICTS}
    return sorted(out, key=lambda r: (-round(r["confidence"], 9), len(r["tokens"]), -r["support"], r["tokens"]))


def _count_sets(baskets: DataFrame, sets: list[tuple[int, list[str]]]) -> DataFrame:
    """(id, n): how many baskets hold each of some combinations, none of which is frequent among them.

    A combination is looked up by its first token; every other token must be there, too.
    """
    table = baskets.sparkSession.createDataFrame(sets, "id long, needs array<string>").withColumn("token", F.element_at("needs", 1))
    single = baskets.select("tokens", F.explode("tokens").alias("token"))
    hit = single.join(F.broadcast(table), "token").filter(F.size(F.array_except("needs", "tokens")) == 0)  # combinations are bounded by the minimum support
    return hit.groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def match_rules(tokens: Column, rules: list[dict]) -> Column:
    """Number of the first rule whose tokens are all there, from an inverted index; null for none.

    A rule is filed under its token that the fewest rules have; a URL's tokens bring up
    the rules filed under them, and these are checked for their other tokens.
    """
    if not rules:
        return F.lit(None).cast("int")
    uses: dict[str, int] = {}
    for r in rules:
        for t in r["tokens"]:
            uses[t] = uses.get(t, 0) + 1
    index: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        index.setdefault(min(r["tokens"], key=lambda t: (uses[t], t)), []).append(i)
    lookup = F.create_map(*[x for t, at in index.items() for x in (F.lit(t), F.array(*map(F.lit, at)))])
    needs = F.array(*[F.array(*map(F.lit, r["tokens"])) for r in rules])

    def first(have: Column) -> Column:
        filed = F.flatten(F.filter(F.transform(have, lambda t: F.try_element_at(lookup, t)), lambda x: x.isNotNull()))
        return F.array_min(F.filter(filed, lambda r: F.forall(F.get(needs, r), lambda t: F.array_contains(have, t))))

    return let(tokens, first)


def url_filter(pages: DataFrame, rules: list[dict], url: str = "url", host_rules=HOST_RULES) -> DataFrame:
    """``pages`` with host, path, rule, verdict and the mined rule's confidence.

    Fixed host rules come first; then the first mined rule that matches; else allow.
    A null URL, or one without ``://``, has an empty host and path and is judged on
    what tokens it has.  Columns named like the results, in any case, give way; rows are
    never lost, repeated ones stay repeated, and an empty table gives an empty one.
    """
    given = [F.col(f"`{c}`") for c in others(pages, ("host", "path", "rule", "verdict", "confidence"))]
    own = F.col(f"`{column_of(pages, url)}`")
    tokens, fixed, hit = (free_name(pages, x) for x in ("tokens__", "fixed__", "hit__"))
    rows = pages.select(*given, host_of(own).alias("host"), path_of(own).alias("path"), url_tokens(own).alias(tokens))
    rows = rows.withColumn(fixed, fixed_rule(F.col("host"), F.col("path"), host_rules)).withColumn(hit, match_rules(F.col(tokens), rules))
    verdicts = F.array(*[F.lit(r["verdict"]) for r in rules]) if rules else F.array().cast("array<string>")
    strength = F.array(*[F.lit(float(r["confidence"])) for r in rules]) if rules else F.array().cast("array<double>")
    mined = F.coalesce(F.get(verdicts, F.col(hit)), F.lit("allow"))
    out = rows.withColumn("rule", F.col(f"{fixed}.rule")).withColumn("verdict", F.coalesce(F.col(f"{fixed}.verdict"), mined))
    out = out.withColumn("confidence", F.when(F.col("rule").isNull(), F.get(strength, F.col(hit))))
    return out.drop(tokens, fixed, hit)


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """URLs with the verdict of their document's labels: the document's number is the last number of the path."""
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]+)[^0-9/]*/?\z", 1)
    # a page whose document has no label, or no number, teaches nothing
    numbered = pages.select("url", number.alias("n")).select("url", F.expr("try_cast(n as long)").alias("doc_id"))
    bad = labels.groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    return numbered.filter("doc_id is not null").join(bad, "doc_id").select("url", F.when(F.col("bad") == 1, F.lit("block")).otherwise(F.lit("allow")).alias("verdict"))


def op1_url_filters(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Host, path, rule and verdict of every page, with rules mined from the labelled ones."""
    rules = mine_rules(page_labels(pages.select("url"), labels))
    return url_filter(pages.select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict", "confidence")
