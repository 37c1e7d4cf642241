"""URL filter: block and allow rules by host and path, carried over to the aliases of a page.

A rule fits its host and all subdomains of it if the path starts with the rule's; the longest rule
(host and path together) wins, and of equally long ones the one that allows. Pages with a rule have
that rule's verdict. The others get theirs from their class of equivalent addresses:

- addresses with one normal form are one node: scheme, fragment, `utm_` parameters, default ports and
  a closing slash don't count, the host's ASCII letters are lower-cased;
- `<link rel=canonical>` and `<meta http-equiv=refresh>` of a page's html are edges to the address
  they name (made absolute; dot segments stay), whether that is a page of the table or not;
- classes are the connected components of these edges, found by large-star and small-star steps in
  Spark. A class with a blocked address and no allowed one is blocked; an explicit allow anywhere in
  it takes precedence. Without either, pages are allowed.

Only edges and hashes are shuffled, never html: nodes are 64-bit hashes. Verdicts are gathered by
node and by class with map-side maxima, and pages meet the blocked nodes only, in a join that Spark can
split where a third of the pages has one address.

Edge cases: null addresses, and those without `://`, have empty host and path, no rule, no node and are
allowed; null html has no edges; tags inside comments and scripts don't count, a `>` in an attribute
ends its tag; links to the page itself, to other schemes without `://` and to fragments are no edges;
repeated rows each get a row; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.jaccard import components
from tidewright.llm.spark_io import kept

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What is taken out of html before tags are looked for, and the parts of tags.
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>"
TAG = r"(?is)<(?:link|meta)\b[^>]*>"
CANONICAL = r"(?is)^<link\b.*\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b"
HREF = r"(?is)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
REFRESH = r"(?is)^<meta\b.*\bhttp-equiv\s*=\s*[\"']?\s*refresh\b"
TO = r"(?is)\bcontent\s*=\s*[\"']?[^\"'>]*?\burl\s*=\s*[\"']?\s*([^\"'>\s]+)"
ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.-]*://"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def _after(url: Column) -> Column:
    """What follows the first `://`; null where there is none."""
    return F.when(F.contains(url, F.lit("://")), F.regexp_replace(url, r"(?s)^.*?://", ""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after(url), r"(?s)^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def normal_form(url: Column) -> Column:
    """Host, path and query of an address as it is compared with others; null without `://`."""
    query = F.regexp_extract(_after(url), r"(?s)^[^?#]*\?([^#]*)", 1)
    some = F.array_join(F.filter(F.split(query, "&"), lambda x: ~x.startswith("utm_") & (x != "")), "&")
    host = F.regexp_replace(host_of(url), r":(?:80|443)?$", "")
    place = F.concat(host, F.regexp_replace(path_of(url), r"/+$", ""))
    return F.when(F.contains(url, F.lit("://")), F.when(some != "", F.concat(place, F.lit("?"), some)).otherwise(place))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The rule (verdict, name) that wins, or null. rules: verdict, host, path."""
    found = F.lit(None).cast("struct<verdict:string,name:string>")
    for verdict, own, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(own + start).alias("name"))).otherwise(found)
    return found


def _targets(html: Column) -> Column:
    """The addresses that a page's canonical links and redirects name, as they stand there."""
    tags = F.regexp_extract_all(F.regexp_replace(html, HIDDEN, ""), F.lit(TAG), F.lit(0))
    href = lambda t: F.concat(*[F.regexp_extract(t, HREF, k) for k in (1, 2, 3)])
    found = F.transform(tags, lambda t: F.when(F.regexp_like(t, F.lit(CANONICAL)), href(t)).when(F.regexp_like(t, F.lit(REFRESH)), F.regexp_extract(t, TO, 1)))
    return F.transform(F.filter(found, lambda x: F.coalesce(x != "", F.lit(False))), lambda x: F.replace(F.trim(x), F.lit("&amp;"), F.lit("&")))


def absolute(link: Column, base: Column) -> Column:
    """A link as a whole address, seen from the page at base; null where it names none."""
    origin = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*", 0)
    place = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*[^?#]*", 0)
    folder = F.when(F.length(path_of(base)) > 0, F.regexp_replace(place, r"[^/]*$", "")).otherwise(F.concat(origin, F.lit("/")))
    return (
        F.when(F.regexp_like(link, F.lit(ABSOLUTE)), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), link))
        .when(F.regexp_like(link, F.lit(SCHEME)) | link.startswith("#") | (link == ""), None)
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("?"), F.concat(place, link))
        .otherwise(F.concat(folder, link))
    )


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict. rules: verdict (allow or block), host, path."""
    url = F.col("url")
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    judged = lambda df: df.withColumns({"host": host_of(url), "path": path_of(url)}).withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    own = judged(source.select("page_id", "url")).select("page_id", "host", "path", F.col("own.name").alias("rule"), F.col("own.verdict").alias("verdict"), F.xxhash64(normal_form(url)).alias("node"), normal_form(url).isNotNull().alias("named"))
    own = kept(own, "judged")

    # A cheap test leaves most html out before any tag is looked for.
    linking = source.filter(F.contains("url", F.lit("://")) & F.regexp_like("html", F.lit("(?i)canonical|http-equiv")))
    links = linking.select("url", F.explode(_targets(F.col("html"))).alias("link")).select(F.xxhash64(normal_form(url)).alias("a"), absolute(F.col("link"), url).alias("url"))
    links = kept(judged(links.filter("url is not null")).select("a", F.xxhash64(normal_form(url)).alias("b"), F.col("own.verdict").alias("verdict")), "links")
    root = components(links.select("a", "b"))
    said = own.filter("named and verdict is not null").select("node", "verdict").unionByName(links.filter("verdict is not null").select(F.col("b").alias("node"), "verdict"))
    marks = [F.max((F.col("verdict") == v).cast("int")).alias(v) for v in ("block", "allow")]
    by_node = said.groupBy("node").agg(*marks)
    classes = by_node.join(root, "node", "left").select(F.coalesce("root", "node").alias("root"), "block", "allow").groupBy("root").agg(F.max("block").alias("block"), F.max("allow").alias("allow"))
    # Nodes without links are their own class.
    bad = kept(classes.filter("block = 1 and allow = 0").select("root"), "blocked")
    blocked = kept(bad.select(F.col("root").alias("node")).unionByName(root.join(bad, "root").select("node")).distinct().withColumn("alias", F.lit("block")), "aliases")
    open_ = own.filter("rule is null").join(blocked, "node", "left").withColumn("verdict", F.when(F.col("named"), F.coalesce("alias", F.lit("allow"))).otherwise("allow"))
    names = ["page_id", "host", "path", "rule", "verdict"]
    return own.filter("rule is not null").select(names).unionByName(open_.select(names))
