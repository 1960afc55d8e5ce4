"""URL filters with redirect equivalence.

Rules name a host and a path; a rule fits its host and all subdomains where
the url's path starts with the rule's, and the longest fitting rule decides.
Urls that no rule fits take part in an equivalence: redirects (``refresh`` in
a page's head, and any edges given) and canonical links join urls into classes,
found as connected components; a class that holds a blocked url blocks all its
members but those that a rule allows explicitly.

A url is known by host, path and query: scheme and fragment don't tell two
apart.  Links are read by an HTML parser, so comments and scripts hold none and
character references are decoded; ``rel`` is taken word by word; targets are
resolved against the page's base (its first ``<base href>``, else its url) as
RFC 3986 says.

Hosts and urls that very many pages share are joined apart from the others
(``common.join_spread``), so no task gets all pages of one.

Edge cases: a null url or one without ``://`` has empty host and path, fits no
rule, has no aliases and is allowed; a link whose target can't be resolved, or
has no host then, is none; repeated rows are judged alike; an empty table gives
no rows; html of any length is parsed whole; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host and path)
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def with_parts(df: DataFrame, url_col: str) -> DataFrame:
    """df with host, path and query of a url in place of it; host is empty without ``://``."""
    kept = [c for c in df.columns if c != url_col]
    url = F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit(""))
    # in steps, so that no expression is written out more than once in the generated code
    rest = df.select(*kept, F.when(F.contains(url, F.lit("://")), F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit("")).alias("_rest"))
    tail = rest.select(*kept, F.translate(F.regexp_extract("_rest", r"^[^/?#]*", 0), UPPER, LOWER).alias("host"), F.regexp_extract("_rest", r"(?s)^[^/?#]*([^#]*)", 1).alias("_tail"))
    return tail.select(*kept, "host", F.regexp_extract("_tail", r"^[^?]*", 0).alias("path"), F.regexp_extract("_tail", r"(?s)(\?.*)$", 1).alias("query"))


def rule_table(spark: SparkSession, rules) -> DataFrame:
    """(rule_host, rule_path, rule, verdict), one row per rule; of repeated rules the last holds."""
    found = {text: verdict for verdict, text in rules}
    rows = [(text[: text.find("/")] if "/" in text else text, text[text.find("/") :] if "/" in text else "", text, v) for text, v in found.items()]
    return spark.createDataFrame(rows, "rule_host string, rule_path string, rule string, verdict string")


def decide(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (host, path, ...) with ``rule`` and ``rule_verdict`` of the longest rule that fits, else null.

    Rules are looked up once per distinct host: its suffixes at dots are joined
    with the rules' hosts, and the rules found are joined back to the urls.
    """
    hosts = urls.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    labels = F.split("host", r"\.")
    suffixes = common.let(labels, lambda x: F.transform(F.sequence(F.lit(1), F.size(x)), lambda i: F.array_join(F.slice(x, i, F.size(x)), ".")))
    fitting = hosts.where("host <> ''").withColumn("rule_host", F.explode(suffixes)).join(rules, "rule_host")
    rule = F.struct(F.length("rule").alias("n"), F.col("rule"), F.col("rule_path").alias("path"), F.col("verdict"))
    fitting = fitting.groupBy("host").agg(F.collect_list(rule).alias("_rules"))
    by_host = common.materialize(hosts.join(fitting, "host", "left"), "hosts", counted="n")
    best = F.array_max(F.filter("_rules", lambda r: F.startswith(F.col("path"), r["path"])))
    joined = common.join_spread(urls, by_host, ["host"]).withColumn("_best", best)
    return joined.withColumns({"rule": F.col("_best.rule"), "rule_verdict": F.col("_best.verdict")}).drop("_rules", "_best")


def targets(url: str | None, html: str) -> list[str]:
    """What a page's canonical links and refreshes point to, resolved."""
    from html.parser import HTMLParser
    from urllib.parse import urljoin

    base, found = url or "", []

    class Head(HTMLParser):
        based = False

        def handle_starttag(self, tag, attrs):
            nonlocal base
            got = {}
            for name, value in attrs:
                got.setdefault(name, value or "")  # of repeated attributes the first holds
            if tag == "base" and "href" in got and not self.based:
                self.based, base = True, resolved(got["href"])
            elif tag == "link" and "canonical" in got.get("rel", "").lower().split():
                found.append(got.get("href"))
            elif tag == "meta" and got.get("http-equiv", "").strip().lower() == "refresh":
                _, _, to = got.get("content", "").replace(",", ";", 1).partition(";")
                name, equals, to = to.strip().partition("=")
                if equals and name.strip().lower() == "url":
                    found.append(to.strip().strip("\"'"))

    def resolved(target: str) -> str:
        target, (scheme, sep, _) = target.strip(" \t\n\r\f"), base.partition("://")
        if not sep or not target:
            return target
        # schemes that the library doesn't take for hierarchical are resolved alike
        joined = urljoin("http" + base[len(scheme) :], target)
        return scheme + joined[4:] if joined.startswith("http://") and not target.lower().startswith("http:") else joined

    parser = Head(convert_charrefs=True)
    parser.feed(html)
    parser.close()
    out = []
    for target in found:
        try:
            out.append(resolved(target or ""))
        except ValueError:  # such as an unclosed bracket in the host
            continue
    return [t for t in out if "://" in t]


def _links(batches):
    common.claim_worker("links")
    import pyarrow as pa

    for batch in batches:
        urls, ends = [], []
        for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for target in targets(url, html):
                urls.append(url)
                ends.append(target)
        yield pa.RecordBatch.from_arrays([pa.array(urls, pa.string()), pa.array(ends, pa.string())], ["url", "target"])


def links(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(url, target): canonical links and redirects that the pages' html declares."""
    html = F.col(f"`{html_col}`").cast("string")
    some = pages.where(html.rlike(r"(?i)canonical|refresh|&")).where(html.rlike(r"(?i)<\s*(link|meta)")).select(F.col(f"`{url_col}`").cast("string").alias("url"), html.alias("html"))
    return some.mapInArrow(_links, "url string, target string")


def _key() -> Column:
    return F.when(F.col("host") != "", F.concat("host", "path", "query"))


def judge(pages: DataFrame, rules, edges: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, host, path, rule, verdict of every page; edges: further (url, target) redirects."""
    spark = pages.sparkSession
    table = rule_table(spark, rules) if not isinstance(rules, DataFrame) else rules
    rows = with_parts(pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url")), "url").withColumn("key", _key()).drop("query")
    rows = common.materialize(rows, "urls")

    found = links(pages, url_col, html_col)
    if edges is not None:
        found = found.unionByName(edges.select("url", "target"))
    ends = with_parts(found, "url").select("target", _key().alias("url_key"))
    ends = with_parts(ends, "target").select("url_key", _key().alias("target_key")).where("url_key is not null and target_key is not null")
    ends = common.materialize(ends.distinct(), "links")
    if not ends.limit(1).count():
        ruled = decide(rows, table)
        return ruled.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("rule_verdict", F.lit("allow")).alias("verdict"))
    classes = common.materialize(connected_components(ends, "url_key", "target_key"), "classes")
    members = classes.select("component", F.col("node").alias("key"), F.regexp_extract("node", r"^[^/?]*", 0).alias("host"), F.regexp_extract("node", r"(?s)^[^/?]*([^?]*)", 1).alias("path"))
    bad = decide(members, table).where("rule_verdict = 'block'").select("component").distinct()
    blocked = classes.join(bad, "component", "left_semi").select(F.col("node").alias("key"), F.lit(True).alias("blocked"))
    named = rows.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(blocked, "key", "left")
    aliased = common.join_spread(rows, common.materialize(named, "blocked", counted="n"), ["key"]).unionByName(rows.where("key is null").withColumn("blocked", F.lit(None).cast("boolean")))
    ruled = decide(aliased, table)
    verdict = F.coalesce("rule_verdict", F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow")))
    return ruled.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages"), RULES)


#: No page of the tables declares a redirect or canonical link, so the rules alone decide here; tests cover the classes.
ORACLE = r"""
with u as (
  select page_id, case when contains(url, '://') then substr(url, position('://' in url) + 3) else '' end as rest from pages),
p as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from u),
r(verdict, h, p, rule) as (values
  ('allow', 'com', '/', 'com/'), ('block', 'example.com', '/en/', 'example.com/en/'),
  ('allow', 'www.example.com', '/en/', 'www.example.com/en/'), ('block', 'net', '/es/', 'net/es/'), ('block', 'net', '/fr/', 'net/fr/')),
best as (
  select page_id, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict
  from p join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, r.p) group by page_id)
select p.page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from p left join best using (page_id)
"""
