"""Queries of what is written: connectors' folders and the index walk, the write-once archive, stored merges and chains."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from clausewise.adapt import sql
from clausewise.constants import AUDIT_GENESIS
from clausewise.operators import catalog, ingest, monitoring, stored
from clausewise.plans.monitoring import _ORDERS, _recorded
from clausewise.sources import payloads
from clausewise.work import shared_dir

#: Entries of a page, and pages that a walk reads at most.
SIZE, CAP = payloads.PAGE_SIZE, payloads.MAX_PAGES


def _folder(t, name):
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def _escaped(c):
    plain = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\p{Cntrl}\x{FFFE}\x{FFFF}]", " ")
    return F.replace(F.replace(F.replace(plain, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _written_pages(t, rows, head, name):
    """Rows (n, entry) as page files of ``SIZE`` entries each, under an element ``head``."""
    payloads.register(t.spark)
    folder = _folder(t, name)
    page = (F.floor(F.col("n") / SIZE) + 1).cast("int").alias("page")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "entry"))), lambda e: e["entry"]), "")
    files = rows.groupBy(page).agg(body.alias("body")).select("page", F.concat(F.lit(f"<{head}>"), "body", F.lit(f"</{head}>")).cast("binary").alias("body"))
    files.write.format("pages").option("path", folder).mode("append").save()
    return folder


def _rule_index(t):
    """An index of rules: a title for each document, but for the eighth entry of the fifth page."""
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    k = F.col("doc_id")
    entry = F.concat(F.lit("<admrul>"), tag("행정규칙일련번호", k.cast("string")), F.when(k != 4 * SIZE + 7, tag("행정규칙명", _escaped(F.col("title")))).otherwise(""), tag("시행일자", F.lit("20240601")), F.lit("</admrul>"))
    folder = _written_pages(t, t.documents().select(k.alias("n"), entry.alias("entry")), "AdmRulSearch", "index")
    return t.spark.read.format("admrul_index").option("path", folder).load()


_INDEX = f"""entries AS (SELECT doc_id, title, doc_id // {SIZE} + 1 AS page FROM docs WHERE doc_id <> {4 * SIZE + 7}),
walked AS (SELECT * FROM entries WHERE page <= {CAP} AND page <= coalesce((SELECT min(page) FROM (SELECT page FROM entries WHERE page <= {CAP} GROUP BY 1 HAVING count(*) < {SIZE})), page))"""


def _feed(t):
    """The crawled addresses as a feed, read back by the connector's name."""
    k = F.col("page_id")
    entry = F.concat(F.lit("<item><title>"), k.cast("string"), F.lit("</title><link>"), _escaped(F.col("url")), F.lit("</link></item>"))
    folder = _written_pages(t, t.raw("pages").select(k.alias("n"), entry.alias("entry")), "rss", "feed")
    return t.spark.read.format("rss").option("path", folder).load()


def _payloads(t):
    return t.raw("pages").select("page_id", F.when(F.col("page_id") % 5 == 0, F.concat("html", F.lit("?key=abc"))).otherwise(F.col("html")).alias("body"))


def _archived(t):
    """Payloads archived in two runs, of which the second brings some again: objects, and what each run did."""
    folder = _folder(t, "archive")
    payloads.archive(_payloads(t).where("page_id % 3 = 0"), folder)
    payloads.archive(_payloads(t), folder)
    return payloads.archived_objects(t.spark, folder), payloads.commits(t.spark, folder)


_BODIES = "bodies AS (SELECT DISTINCT page_id % 3 = 0 AS early, page_id % 5 = 0 OR regexp_matches(html, '[?&](OC|oc|key|apikey|api_key)=[^&\\s{]') AS secret, sha256(CASE WHEN page_id % 5 = 0 THEN html || '?key=abc' ELSE html END) AS digest, octet_length(encode(html)) AS raw_bytes FROM pages WHERE html IS NOT NULL)"

def _standards(t):
    """Recognised standards in two batches, the second of which comes twice."""
    name = F.when(F.col("p_partkey") % 3 > 0, F.col("p_brand")).alias("edition")
    rows = lambda every, seen: t.raw("part").where(f"p_partkey % {every} = 0").select(F.col("p_partkey").alias("num"), name, F.lit(seen).alias("seen"))
    table = stored.Table(t.spark, _folder(t, "standards"), "num long, edition string, seen int", ["num", "edition"])
    rule = lambda held, new: catalog.merged(held, new, ["num", "edition"], ["seen"])
    for batch, new in (("one", rows(2, 1)), ("two", rows(3, 2)), ("two", rows(3, 9))):
        table.merge(batch, new, rule)
    return table.rows()


def _claims(t):
    """Claims of cells in three batches that overlap."""
    table = stored.Table(t.spark, _folder(t, "claims"), "doc_id long, cell_id string", ["doc_id"])
    for every in (2, 3, 6):
        table.merge(f"every {every}", t.document_cells().where(f"doc_id % {every} = 0"), ingest.claims_upsert)
    return table.rows()


def _stored_alerts(t):
    """Alerts on record, then those of a run, then the same run again."""
    old, new = _recorded(t)
    columns = ["tenant", "cell_id", "version_id", "severity", "owner", "delivery"]
    table = stored.Table(t.spark, _folder(t, "alerts"), "tenant long, cell_id long, version_id long, severity string, owner string, delivery string", ["version_id"])
    table.merge("record", old.select(*columns), lambda held, rows: held.unionByName(rows))
    for _ in range(2):
        table.merge("run", new.select("tenant", "cell_id", "version_id", "severity"), monitoring.upserted)
    return table.rows()


def _chained(t):
    """Conversations as hash chains in three appends by turn, the last one given twice."""
    rows = t.raw("conversations").select(F.col("conv_id").alias("chain"), F.col("turn").alias("place"), F.concat_ws("|", "role", "text").alias("body"))
    log = stored.Chains(t.spark, _folder(t, "chains"), AUDIT_GENESIS)
    for name, part in (("a", "place < 2"), ("b", "place BETWEEN 2 AND 3"), ("c", "place > 3"), ("c", "place > 3")):
        log.append(name, rows.where(part))
    return log.entries()


#: The first links of every chain, hash by hash: as many as SQL can nest.
_LINKS = f"""links AS (SELECT conv_id, turn, concat_ws('|', role, text) AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq FROM conversations),
l0 AS (SELECT conv_id, seq, '{AUDIT_GENESIS}' AS prev_hash, sha256(body || '{AUDIT_GENESIS}') AS entry_hash FROM links WHERE seq = 0),
l1 AS (SELECT l.conv_id, l.seq, p.entry_hash AS prev_hash, sha256(body || p.entry_hash) AS entry_hash FROM links l JOIN l0 p USING (conv_id) WHERE l.seq = 1),
l2 AS (SELECT l.conv_id, l.seq, p.entry_hash AS prev_hash, sha256(body || p.entry_hash) AS entry_hash FROM links l JOIN l1 p USING (conv_id) WHERE l.seq = 2)"""

QUERIES = {
    "A2_chain_append": (
        lambda t: _chained(t).select("chain", "seq", F.when(F.col("seq") < 3, F.col("entry_hash")).alias("entry_hash")),
        f"WITH {_LINKS} SELECT conv_id AS chain, seq, entry_hash FROM links LEFT JOIN (FROM l0 UNION ALL FROM l1 UNION ALL FROM l2) USING (conv_id, seq)"),
    "A3_appended_verify": (
        lambda t: catalog.verify_chain(_chained(t), AUDIT_GENESIS), "SELECT conv_id AS chain, count(*) AS n, CAST(NULL AS BIGINT) AS first_bad FROM conversations GROUP BY 1"),
    "C7_stored_claims": (_claims, sql("SELECT doc_id, cell_id FROM doc_cells WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")),
    "C11_stored_standards": (
        _standards, "SELECT p_partkey AS num, CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS edition, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS seen FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0"),
    "M7_stored_alerts": (
        _stored_alerts,
        f"WITH {_ORDERS} SELECT tenant, cell_id, alert_id AS version_id, CASE WHEN alert_id % 3 > 0 THEN severity ELSE 'low' END AS severity, CASE WHEN alert_id % 3 < 2 AND alert_id % 2 = 0 THEN 'kim' END AS owner, CASE WHEN alert_id % 3 < 2 THEN 'sent' ELSE 'pending' END AS delivery FROM al"),
    "S1_connector_fetch": (
        lambda t: _feed(t).select("page", "position", "title", F.coalesce("link", F.lit("")).alias("link")),
        f"SELECT CAST(page_id // {SIZE} + 1 AS INTEGER) AS page, CAST(page_id % {SIZE} AS INTEGER) AS position, CAST(page_id AS VARCHAR) AS title, trim(coalesce(url, '')) AS link FROM pages"),
    "S2_connector_lookup": (
        lambda t: _feed(t).where("page > 1 AND page <= 3").groupBy("page").agg(F.count("*").alias("n"), F.bool_or("full").alias("full")),
        f"SELECT CAST(page_id // {SIZE} + 1 AS INTEGER) AS page, count(*) AS n, count(*) = {SIZE} AS full FROM pages WHERE page_id // {SIZE} + 1 BETWEEN 2 AND 3 GROUP BY 1"),
    "S17_archive": (
        lambda t: _archived(t)[0].select("digest", "raw_bytes", "sound"),
        f"WITH {_BODIES} SELECT digest, any_value(raw_bytes) AS raw_bytes, true AS sound FROM bodies WHERE NOT secret GROUP BY 1"),
    "S17_archive_runs": (
        lambda t: _archived(t)[1].select("written", "kept", "refused"),
        f"""WITH {_BODIES}, d AS (SELECT digest, bool_or(early) AS early, bool_or(secret) AS secret FROM bodies GROUP BY 1)
        SELECT count(*) FILTER (WHERE early AND NOT secret) AS written, 0 AS kept, count(*) FILTER (WHERE early AND secret) AS refused FROM d UNION ALL SELECT count(*) FILTER (WHERE NOT early AND NOT secret), count(*) FILTER (WHERE early AND NOT secret), count(*) FILTER (WHERE secret) FROM d"""),
    "S19_index_walk": (
        lambda t: payloads.index_walk(_rule_index(t), CAP)[0].select("page", F.col("admrul_id").cast("long").alias("doc_id"), "title"),
        sql("SELECT CAST(page AS INTEGER) AS page, doc_id, title FROM walked", _INDEX)),
    "S19_truncated": (
        lambda t: payloads.index_walk(_rule_index(t), CAP)[1],
        sql(f"SELECT count(DISTINCT page) = {CAP} AND min(n) >= {SIZE} AS truncated FROM (SELECT page, count(*) AS n FROM walked GROUP BY 1)", _INDEX)),
}
