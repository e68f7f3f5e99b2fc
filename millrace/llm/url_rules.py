"""URL verdicts from host and path rules, with decisions carried along redirects and canonical links.

DataFrame functions only. A page's own rule decides first. A page without one takes part in redirect equivalence: redirect
and canonical-link edges join URLs into connected components, and inside a component an explicit allow beats a block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .page_links import absolute, alias_targets

#: The rule list is a literal in the plan, so its size is checked.
MAX_RULES = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, ASCII lower case; empty without ``://`` or for null."""
    return ascii_lower(F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def url_key(url: Column) -> Column:
    """The node of a URL: host, path and query, without scheme and fragment; null if there is no host."""
    rest = F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^#]*)", 1)
    return F.when(F.length(url_host(url)) > 0, F.concat(url_host(url), rest))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct ``(rule, action)`` of the longest ``(host, path, action)`` rule that fits, else null.

    A rule fits its host and all subdomains if the path starts with the rule's. Length counts host and path together; of
    equally long rules the one with the longer host wins, then allow.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} fit into a plan")
    by_host: dict[str, list[tuple[str, str]]] = {}
    for h, p, action in rules:
        by_host.setdefault(h.lower(), []).append((p, action))
    if not by_host:
        return F.lit(None).cast("struct<rule:string,action:string>")
    entry = lambda h, p, a: F.struct(
        F.lit(len(h) + len(p)).alias("size"), F.lit(len(h)).alias("host_size"), F.lit(int(a == "allow")).alias("allow"),
        F.lit(p).alias("path"), F.lit(h + p).alias("rule"), F.lit(a).alias("action"),
    )
    table = F.create_map(*[x for h, own in by_host.items() for x in (F.lit(h), F.array(*[entry(h, p, a) for p, a in own]))])
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    known = F.filter(F.transform(suffixes, lambda s: F.try_element_at(table, s)), lambda own: own.isNotNull())
    fits = F.filter(F.flatten(known), lambda r: F.startswith(path, r["path"]))
    best = F.array_max(fits)
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["action"].alias("action")))


def alias_edges(pages: DataFrame) -> DataFrame:
    """``(src, dst)`` URL keys from all canonical links and meta refreshes in ``html``, and from a ``redirect_url`` column if any.

    Only markup counts: what comments, scripts, styles, templates and texts hold is no link. A ``<base>`` and character references are heeded.
    """
    targets = alias_targets(F.col("html"), F.col("url"))
    if "redirect_url" in pages.columns:
        targets = F.concat(targets, F.array(absolute(F.col("redirect_url").cast("string"), F.col("url"))))
    found = pages.where(F.length(url_host(F.col("url"))) > 0).select(url_key(F.col("url")).alias("src"), F.explode(targets).alias("to"))
    return found.select("src", url_key(F.col("to")).alias("dst")).where("dst IS NOT NULL AND src <> dst").distinct()


def url_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict``.

    The longest fitting rule decides. Otherwise, if an alias of the page (a URL in the same component of redirect and canonical
    edges, crawled or not) has an explicit allow, it is allowed; else if one is blocked, it is blocked; else ``default`` holds.
    A null URL, or one without ``://``, has an empty host and path and no aliases. Repeated rows are judged alike; other
    columns are ignored.
    """
    want = [c for c in ("page_id", "url", "html", "redirect_url") if c in pages.columns]
    pages = pages.select(*want)
    if "html" not in want:
        pages = pages.withColumn("html", F.lit(None).cast(T.StringType()))
    edges = alias_edges(pages)
    parts = connected_components(edges)

    def judged(df: DataFrame, host: Column, path: Column) -> DataFrame:
        return df.withColumn("_rule", rule_of(host, path, rules))

    as_url = F.concat(F.lit("http://"), F.col("node"))
    of_class = (
        judged(parts, url_host(as_url), url_path(as_url))
        .groupBy("component")
        .agg(
            F.bool_or(F.col("_rule.action") == "allow").alias("allowed"),
            F.bool_or(F.col("_rule.action") == "block").alias("blocked"),
        )
    )
    inherited = (
        parts.join(of_class, "component")
        .where(F.col("allowed") | F.col("blocked"))
        .select(F.col("node").alias("_key"), F.when(F.col("allowed"), "allow").otherwise("block").alias("_inherited"))
    )
    own = judged(
        pages.select("page_id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")),
        F.col("host"),
        F.col("path"),
    ).withColumn("_key", F.coalesce(url_key(F.col("url")), F.concat(F.lit(" "), F.xxhash64("page_id", "url").cast("string"))))  # pages without a host share no key
    return own.join(inherited, "_key", "left").select(
        "page_id",
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.action"), F.col("_inherited"), F.lit(default)).alias("verdict"),
    )
