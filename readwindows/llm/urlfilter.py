"""URL filters: curated rules first, association rules mined by FP-growth for the rest.

A curated rule is a host and a path. It fits a url whose host is that host or a subdomain and
whose path begins with its path; of several the longest wins. A url that none fits is judged
by mined rules: combinations of url tokens that go with one label. They come from Spark's
FP-growth over labelled urls, by default those that the curated rules decide. Rules below the
wanted support or confidence leave, and so does a rule that says no more than one with fewer
tokens. What remains is matched by an inverted index from token to rules: a rule fires when
as many of its tokens were met as it has. The surest rule decides; without one, ``DEFAULT``.

Mining uses a bounded sample of the labelled urls (``SAMPLE``); every url is judged. Defined
cases: host and path of a null url, or of one without ``://``, are empty and the default
decides; rows are judged one by one, so repeated and null ids don't matter; extra columns are
ignored; without labelled urls no rule is mined.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readwindows.session import stage

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DEFAULT = "allow"
SAMPLE = 20_000
SUPPORT, CONFIDENCE = 0.005, 0.8
#: Tokens in a mined rule, at most. The support bounds how many rules there are.
RULE_TOKENS = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def parts(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path."""
    host, path = host_and_path(F.col("url"))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).select("*", host.alias("host"), path.alias("path"))


def curated(rows: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    """``rows`` with the longest fitting rule, as ``rule`` and ``ruled``, both null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rows.select("*", rule.alias("rule"), verdict.alias("ruled"))


def tokens() -> Column:
    """Distinct tokens of a url: scheme, labels of the host, shapes and texts of the path's parts, names in its query."""
    host = F.transform(F.filter(F.split("host", r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("host:"), x))
    last = F.concat(F.lit("last:"), F.substring_index("host", ".", -1))
    pieces = F.filter(F.split(F.lower("path"), r"[/._\-]"), lambda x: x != "")
    words = F.transform(pieces, lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, "[0-9]+", "#")))
    first = F.transform(F.slice(pieces, 1, 2), lambda x: F.concat(F.lit("start:"), F.substring(F.regexp_replace(x, "[0-9]+", "#"), 1, 8)))
    query = F.transform(F.regexp_extract_all("url", F.lit(r"[?&]([A-Za-z_\-]+)="), F.lit(1)), lambda x: F.concat(F.lit("query:"), x))
    scheme = F.concat(F.lit("scheme:"), F.lower(F.substring_index("url", "://", 1)))
    found = F.concat(F.array(last, scheme, F.when(F.col("url").contains("#"), F.lit("fragment"))), host, words, first, query)
    return F.array_distinct(F.array_compact(F.coalesce(found, F.array().cast("array<string>"))))


class Index:
    """Mined rules by token: (needed tokens, verdict, confidence, support) and the rules each token belongs to."""

    def __init__(self, rules: list[tuple[tuple[str, ...], str, float, float]]):
        self.rules = sorted(rules, key=lambda r: (-r[2], -r[3], len(r[0]), r[0], r[1]))
        self.of: dict[str, list[int]] = {}
        for k, (needed, *_) in enumerate(self.rules):
            for token in needed:
                self.of.setdefault(token, []).append(k)

    def decide(self, found: list[str]) -> int | None:
        """The surest rule all of whose tokens are in ``found``."""
        met: dict[int, int] = {}
        best = None
        for token in found:
            for k in self.of.get(token, ()):
                met[k] = met.get(k, 0) + 1
                if met[k] == len(self.rules[k][0]) and (best is None or k < best):
                    best = k
        return best


def pruned(rules: DataFrame) -> DataFrame:
    """(needed, label, confidence, support) without the rules of which a part is at least as sure of the same label."""
    rules = stage(rules, "rules")
    sizes = F.sequence(F.lit(1), F.expr(f"cast(shiftleft(1, least(size(needed), {RULE_TOKENS})) as int) - 2"))
    chosen = rules.where(F.size("needed") > 1).select("needed", "label", "confidence", F.explode(sizes).alias("mask"))
    part = F.expr("filter(needed, (x, i) -> (shiftright(mask, i) & 1) = 1)")
    parts = chosen.select(F.col("needed").alias("whole"), "label", F.col("confidence").alias("of"), part.alias("needed"))
    worse = parts.join(rules.select("needed", "label", "confidence"), ["needed", "label"]).where("confidence >= of")
    return rules.join(worse.select(F.col("whole").alias("needed"), "label").distinct(), ["needed", "label"], "left_anti")


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> Index:
    """Association rules from (url, host, path, label): which token combinations go with a label."""
    total = labelled.count()
    if not total:
        return Index([])
    share = min(1.0, SAMPLE / total)
    rows = labelled.where(F.pmod(F.xxhash64("url"), F.lit(1 << 20)) < int(share * (1 << 20)))
    items = rows.select(F.array_append(tokens(), F.concat(F.lit("label="), F.col("label"))).alias("items"))
    model = FPGrowth(minSupport=support, minConfidence=confidence, numPartitions=8).fit(items)
    rules = model.associationRules.where("consequent[0] like 'label=%' and not exists(antecedent, x -> x like 'label=%')")
    label = F.substring(F.get("consequent", 0), len("label=") + 1, 1 << 30)
    rules = rules.where(F.size("antecedent") <= RULE_TOKENS).select(F.array_sort("antecedent").alias("needed"), label.alias("label"), "confidence", "support")
    return Index([(tuple(r.needed), r.label, r.confidence, r.support) for r in pruned(rules).collect()])


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, and ``mined``: the tokens of the mined rule that decided, if one did."""
    rows = curated(parts(pages), rules)
    if labelled is None:
        labelled = rows.where("ruled is not null").withColumn("label", F.col("ruled"))
    index = mine(labelled)
    sent = pages.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        for batch in batches:
            ruled, found = batch.column("ruled").to_pylist(), batch.column("found").to_pylist()
            verdict, mined = [], []
            for r, f in zip(ruled, found, strict=True):
                k = None if r is not None else sent.value.decide(f)
                verdict.append(r if r is not None else DEFAULT if k is None else sent.value.rules[k][1])
                mined.append(None if k is None else ",".join(sent.value.rules[k][0]))
            columns = [*(batch.column(c) for c in ("page_id", "host", "path", "rule")), pa.array(verdict, pa.string()), pa.array(mined, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "host", "path", "rule", "verdict", "mined"])

    seen = rows.select("page_id", "host", "path", "rule", "ruled", tokens().alias("found"))
    return seen.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, mined string")
