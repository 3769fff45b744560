"""URL filtering by explicit rules and by mined association rules.

Explicit rules (host, path) fit a host and its subdomains where the url's path starts with theirs; the longest
wins. Urls that a rule judges are labelled rows: FP-growth mines frequent combinations of their tokens and the verdict,
and combinations that point to a verdict with enough confidence and support become rules. A rule implied by a
shorter one for the same verdict is pruned. Urls without an explicit rule are matched through an inverted index
that lists each mined rule under its rarest token; the most confident fitting rule wins, else the url is allowed.

A combination is frequent with SUPPORT of the labelled urls, and LEAST_URLS of them. So the number of mined rules is bounded by the
support threshold, not by the number of urls.

Cases: null urls or urls without `://` have an empty host and path, fit no rule and have no tokens: they are allowed;
repeated rows are labelled and judged as often as they come; below LEAST_URLS labelled urls no rule is mined, and urls without an
explicit rule are allowed; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations, product

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
SUPPORT, CONFIDENCE = 0.002, 0.9
#: Labelled urls that a rule needs at least, whatever the share.
LEAST_URLS = 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url):
    """(host, path) columns of a url column."""
    known = F.coalesce(url, F.lit(""))
    at = F.instr(known, "://")
    rest = F.when(at > 0, F.substring(known, at + 3, F.length(known))).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(known)), r"^[^?#]*", 0)
    return F.translate(raw, _UPPER, _LOWER), path


def explicit(df: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule (host + path of the longest that fits, else null) and given (its verdict)."""
    out = F.lit(None).cast("struct<rule:string,given:string>")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # a longer one overrides
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("given"))).otherwise(out)
    return df.withColumn("m", out).select("*", "m.rule", "m.given").drop("m")


def query_of(url):
    """The query string of a url column: what lies between the first `?` and `#`."""
    known = F.coalesce(url, F.lit(""))
    return F.when(F.instr(known, "://") > 0, F.regexp_extract(known, r"^[^?#]*\?([^#]*)", 1)).otherwise("")


def _named(name: str, a):
    return F.transform(F.filter(a, lambda x: x != ""), lambda x: F.concat(F.lit(name + "="), x))


def tokens(host, path, query=None):
    """Distinct tokens of a url: every host label by its place from the right and by word; the first path part (p), the
    first character of the second (q), every part of several words (d) and every word of the path in lower case (t); the
    path's ending (x) and the keys of the query (k). The support threshold drops the rare ones."""
    labels = F.reverse(F.split(host, r"\.", -1))
    placed = F.transform(labels, lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit("="), x))
    parts = F.filter(F.split(path, "/", -1), lambda x: x != "")
    found = [
        placed,
        _named("w", F.split(host, r"[.\-]", -1)),
        _named("p", F.slice(parts, 1, 1)),
        _named("q", F.transform(F.slice(parts, 2, 1), lambda x: F.substring(x, 1, 1))),
        _named("d", F.filter(parts, lambda x: x.rlike(r"[^\p{L}\p{N}]"))),
        _named("t", F.split(F.translate(path, _UPPER, _LOWER), r"[^\p{L}\p{N}]+", -1)),
        _named("x", F.array(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1))),
    ]
    if query is not None:
        found.append(_named("k", F.transform(F.split(query, "[&;]", -1), lambda x: F.regexp_extract(x, "^[^=]*", 0))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(*found)))


def _alike(labelled: DataFrame, least: int) -> tuple[dict[str, list[str]], dict[str, int]]:
    """Tokens of `least` urls or more by the first of those that occur in exactly the same urls (by two 64-bit hashes), and the urls of each."""
    rows = labelled.select(F.monotonically_increasing_id().alias("rid"), F.explode(F.array_distinct("items")).alias("token"))
    seen = rows.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("rid")).alias("a"), F.bit_xor(F.xxhash64("rid", F.lit(1))).alias("b")).where(F.col("n") >= least)
    groups: dict[tuple, list[str]] = {}
    for r in sorted(seen.collect()):
        groups.setdefault((r.n, r.a, r.b), []).append(r.token)
    return {g[0]: g for g in groups.values()}, {t: n for (n, _, _), g in groups.items() for t in g}


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST_URLS) -> tuple[list[tuple[tuple[str, ...], str, float, float]], dict[str, int]]:
    """(tokens, verdict, confidence, support) of pruned rules, from rows (items, given); and the labelled urls of each frequent token.

    Of tokens that occur in the same urls one stands for all while combinations are mined, as k of them would make 2^k
    combinations; each rule is then given with every choice among them."""
    from pyspark.ml.fpm import FPGrowth

    n = labelled.count()
    if n < max(1, least):  # no combination can have so many urls
        return [], {}
    share = max(support, least / n)
    groups, uses = _alike(labelled, math.ceil(share * n))
    first = {t: f for f, g in groups.items() for t in g}

    def run(batches):
        for batch in batches:
            kept = [sorted({first[t] for t in items if t in first}) + ["verdict=" + g] for items, g in zip(batch["items"].to_pylist(), batch["given"].to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.list_(pa.string()))], ["items"])

    rows = labelled.select("items", "given").mapInArrow(run, "items array<string>")
    scratch = Scratch(labelled.sparkSession, "mined")
    sets = scratch.write(FPGrowth(itemsCol="items", minSupport=share).fit(rows).freqItemsets, "sets")
    # Only rules for a verdict are made, and only those that no rule with one token less makes needless reach the driver.
    named = sets.withColumn("a", F.array_sort(F.filter("items", lambda x: ~x.startswith("verdict=")))).where(F.size("a") > 0)
    whole = named.where(F.size("a") == F.size("items")).select("a", F.col("freq").alias("all"))
    judged = named.where(F.size("a") < F.size("items")).select("a", F.filter("items", lambda x: x.startswith("verdict="))[0].alias("v"), "freq")
    made = judged.join(whole, "a").withColumn("c", F.col("freq") / F.col("all")).where(F.col("c") >= confidence)
    made = scratch.write(made.select("a", "v", "c", (F.col("freq") / F.lit(n)).alias("s")), "rules")
    less = made.select("*", F.explode_outer(F.transform("a", lambda x: F.array_remove(F.col("a"), x))).alias("b"))
    needless = less.join(made.select(F.col("a").alias("b"), "v"), ["b", "v"], "left_semi").select("a", "v").distinct()
    found = made.join(needless, ["a", "v"], "left_anti").select("a", "v", "c", "s").collect()
    scratch.drop(sets, made)
    rules: list[tuple[tuple[str, ...], str, float, float]] = []
    shorter: dict[str, set[frozenset]] = {}
    sizes: dict[str, set[int]] = {}
    for items, verdict, c, s in sorted(((tuple(sorted(a)), v[8:], c, s) for a, v, c, s in found), key=lambda r: (len(r[0]), -r[2], r[0], r[1])):
        known = shorter.setdefault(verdict, set())
        if any(x.startswith("verdict=") for x in items) or any(frozenset(x) in known for k in sizes.setdefault(verdict, set()) for x in combinations(items, k)):
            continue
        known.add(frozenset(items))
        sizes[verdict].add(len(items))
        rules += [(tuple(sorted(chosen)), verdict, c, s) for chosen in product(*(groups[t] for t in items))]
    return rules, uses


class RuleIndex:
    """Rules listed under their token that the fewest urls have."""

    def __init__(self, rules, uses: dict[str, int]):
        self.under: dict[str, list] = {}
        for r in rules:
            self.under.setdefault(min(r[0], key=lambda t: (uses[t], t)), []).append(r)

    def judge(self, items: list[str]) -> str | None:
        have = set(items)
        fitting = [r for t in have for r in self.under.get(t, ()) if have.issuperset(r[0])]
        return min(fitting, key=lambda r: (-r[2], -r[3], r[1] != "block", r[0]))[1] if fitting else None


def url_verdicts(pages: DataFrame, rules=RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict, one row per row of pages."""
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = split_url(F.col("url"))
    read = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"), query_of(F.col("url")).alias("query"))
    parsed = scratch.write(explicit(read, rules).withColumn("items", tokens(F.col("host"), F.col("path"), F.col("query"))).drop("query"), "urls")
    index = RuleIndex(*mine(parsed.where("given is not null"), support, confidence))

    def run(batches):
        for batch in batches:
            items, given = batch["items"].to_pylist(), batch["given"].to_pylist()
            verdict = [g or index.judge(i) or "allow" for i, g in zip(items, given)]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["host"], batch["path"], batch["rule"], pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return parsed.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
