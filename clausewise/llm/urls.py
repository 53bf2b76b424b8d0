"""URL filter: host and path rules, and redirect equivalence.

Rules.  A rule names a host and the start of a path; it fits the host and all its subdomains, and the longest
fitting rule (host and path characters) decides, allow before block among equals.  Rules are a list in the
caller's hands; they become one literal map, so judging a page is a projection without join or shuffle.

Equivalence.  Addresses that stand for each other share a component: edges lead from a page's url to the targets of
its canonical link and its refresh redirect, and between the ends of given redirect records, and from nowhere else.  Two urls are
one address if they differ in a fragment, in the case of scheme or host, or in an empty path against ``/``; what else
spells alike (tracking parameters, http and https, a closing slash) may name different pages and is merged only on demand
(``spellings``).  Every address of the graph is judged by the rules, whether it was crawled or only named by a link.  Distributed
connected components carry decisions to pages without a rule of their own: an explicit allow anywhere in the component precedes,
then a block, else the default (allow).  Links inside comments and scripts are text and name nothing.

Links are read as browsers do: character references are decoded, ``//host/`` takes the page's scheme, ``/path`` its
host, ``?query`` its path, and others its folder, with ``.`` and ``..`` resolved.  A link of another scheme without
``://`` (``mailto:``) names no address.

Edge cases: a null url and one without ``://`` have empty host and path and no rule and keep the default; repeated
pages and urls give repeated rows, and a url that a third of all pages share is dealt out; null html has no links; no
page, no row; other columns of ``pages`` are not read; a page of any length is read in linear time (a tag
ends at the next angle bracket).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import join_facts, materialize
from clausewise.llm.components import connected_components

ALLOW, BLOCK = "allow", "block"
Rule = tuple[str, str, str]  # verdict, host, path
# Parameters that name how a visitor came, not what they see.
TRACKING = r"utm_[a-z]+|gclid|fbclid|ref"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(x: Column) -> Column:
    return F.translate(x, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def parse_rules(text: str) -> list[Rule]:
    """``allow host/path`` and ``block host/path``, one on a line."""
    out = []
    for line in text.split("\n"):
        if line.strip():
            verdict, target = line.split(None, 1)
            host, _, path = target.strip().partition("/")
            if verdict not in (ALLOW, BLOCK):
                raise ValueError(f"a rule allows or blocks: {line}")
            out.append((verdict, host.lower(), f"/{path}"))
    return out


def matched(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null where none does."""
    kind = "array<struct<size:int,verdict:string,host:string,path:string>>"
    by_host: dict[str, list[Rule]] = {}
    for r in rules:
        by_host.setdefault(r[1], []).append(r)
    if not by_host:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    literal = F.create_map(*(
        x for h, rs in by_host.items()
        for x in (F.lit(h), F.array(*(F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rs)))))
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    fitting = F.filter(F.flatten(F.transform(suffixes, lambda s: F.coalesce(F.try_element_at(literal, s), F.array().cast(kind)))), lambda r: F.startswith(path, r["path"]))
    best = F.array_max(F.transform(fitting, lambda r: F.struct(r["size"].alias("size"), (r["verdict"] == ALLOW).alias("allows"), r["host"].alias("host"), r["path"].alias("path"), r["verdict"].alias("verdict"))))
    return F.when(best.isNotNull() & (host != ""), F.struct(F.concat(best["host"], best["path"]).alias("rule"), best["verdict"].alias("verdict")))


def address(url: Column, spellings: bool = False) -> Column:
    """What a url names: without fragment, scheme and host in lower case, an empty path as ``/``.

    With ``spellings`` scheme, tracking parameters and closing slashes do not count either.
    """
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    if spellings:
        tidy = F.regexp_replace(rest, rf"(?<=[?&])(?:{TRACKING})=[^&]*&?", "")
        return F.concat(host_of(url), F.regexp_replace(F.regexp_replace(tidy, r"[?&]+$", ""), r"/+$", ""))
    rooted = F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.concat(lower_ascii(F.regexp_extract(url, r"(?s)^(.*?://)", 1)), host_of(url), rooted)


# Character references in attribute values.
REFERENCES = (("&quot;", '"'), ("&#34;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&lt;", "<"), ("&#60;", "<"), ("&gt;", ">"), ("&#62;", ">"), ("&#47;", "/"), ("&#x2f;", "/"), ("&#x2F;", "/"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&"))


def _decoded(value: Column) -> Column:
    for name, char in REFERENCES:
        value = F.replace(value, F.lit(name), F.lit(char))
    return F.trim(value)


def _links(html: Column) -> Column:
    """Targets of canonical links and of refresh redirects."""
    # an open comment or script reaches to the end of the page
    html = F.regexp_replace(html, r"(?is)<!--.*?(?:-->|$)|<(script|style)\b.*?(?:</\1\s*>|$)", " ")
    tags = F.regexp_extract_all(html, F.lit(r"(?is)(<link\b[^<>]*\brel\s*=\s*[\"']?canonical\b[^<>]*>|<meta\b[^<>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^<>]*>)"), F.lit(1))
    value = r"(?is)\b{}\s*=\s*(?:\"([^\"<>]*)\"|'([^'<>]*)'|([^\"'\s<>]+))"
    found = lambda t, name: F.concat(*(F.regexp_extract(t, value.format(name), k) for k in (1, 2, 3)))
    redirect = lambda t: F.regexp_extract(found(t, "content"), r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)
    targets = F.transform(tags, lambda t: _decoded(F.when(F.lower(F.substring(t, 1, 5)) == "<link", found(t, "href")).otherwise(redirect(t))))
    return F.when(F.lower(html).rlike("canonical|refresh"), F.filter(targets, lambda t: t != ""))


def _without_dots(path: Column) -> Column:
    """A path whose segments . and .. are resolved."""
    kept = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))))
    closing = F.when(path.rlike(r"/\.\.?$"), "/").otherwise("")
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.array_join(kept, "/"), closing)).otherwise(path)


def resolved(base: Column, link: Column) -> Column:
    """The address that ``link`` names on the page ``base``; null where it names none."""
    origin, path = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1), path_of(base)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, r"(?s)^(.*/)", 1))
    link_path, rest = F.regexp_extract(link, r"(?s)^([^?#]*)", 1), F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    return (
        F.when(link.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), link)
        .when(link.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(F.startswith(link, F.lit("//")), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), link))
        .when(F.startswith(link, F.lit("/")), F.concat(origin, _without_dots(link_path), rest))
        .when(F.startswith(link, F.lit("?")), F.concat(origin, path, link))
        .when(F.startswith(link, F.lit("#")), F.concat(F.regexp_extract(base, r"(?s)^([^#]*)", 1), link))
        .otherwise(F.concat(origin, _without_dots(F.concat(folder, link_path)), rest)))


def named_links(pages: DataFrame, redirects: DataFrame | None = None, spellings: bool = False) -> DataFrame:
    """a, b (nodes), source, target: what each page's links and each redirect record (source, target) name."""
    out = pages.select("url", F.explode(_links(F.col("html"))).alias("link")).where(F.col("url").contains("://")).select(
        F.col("url").alias("source"), resolved(F.col("url"), F.col("link")).alias("target")).where("target IS NOT NULL")
    if redirects is not None:
        out = out.unionByName(redirects.where(F.col("source").contains("://") & F.col("target").contains("://")).select("source", "target"))
    node = lambda c: F.xxhash64(address(F.col(c), spellings))
    return out.select(node("source").alias("a"), node("target").alias("b"), "source", "target")


def judge(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None, default: str = ALLOW, spellings: bool = False) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of ``pages``."""
    url = F.col("url")
    own = materialize(pages.select(
        F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"),
        F.when(url.contains("://"), F.xxhash64(address(url, spellings))).alias("node")).withColumn("hit", matched(F.col("host"), F.col("path"), rules)), "urls-own")
    verdict = lambda c: matched(host_of(F.col(c)), path_of(F.col(c)), rules)["verdict"]
    links = materialize(named_links(pages, redirects, spellings).select("a", "b", verdict("source").alias("va"), verdict("target").alias("vb")), "urls-links")
    parts = materialize(connected_components(links.select("a", "b")), "urls-parts")
    # every address that a rule decides, crawled or named; 'allow' sorts before 'block'
    known = own.select("node", F.col("hit.verdict").alias("verdict")).unionByName(links.select(F.col("a").alias("node"), F.col("va").alias("verdict"))).unionByName(
        links.select(F.col("b").alias("node"), F.col("vb").alias("verdict"))).where("node IS NOT NULL AND verdict IS NOT NULL").groupBy("node").agg(F.min("verdict").alias("verdict"))
    decided = materialize(known.join(parts, "node").groupBy("component").agg(F.min("verdict").alias("spread")), "urls-decided")
    carried = materialize(join_facts(parts, decided, "component").select("node", "spread"), "urls-carried")
    return join_facts(own, carried, "node", "left").select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", "spread", F.lit(default)).alias("verdict"))
