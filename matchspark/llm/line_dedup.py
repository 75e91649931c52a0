"""Site-relative line frequency: lines on too large a share of a host's pages are boilerplate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchspark.llm.text import unused
from matchspark.session import cut

#: A line goes if it is on more than this share of its host's pages, and on so many pages at least.
MAX_SHARE, MIN_PAGES = 0.05, 3


#: Documents with dropped lines up to this number are told apart on the map side, so that only their texts are shuffled.
FEW = 1_000_000


def line_dedup(docs: DataFrame, host: str = "source", max_share: float = MAX_SHARE, min_pages: int = MIN_PAGES, copies_once: bool = False, few: int = FEW) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``; rows and other columns stay.

    A line is what stands between line feeds; blank lines (only spaces) are never dropped.
    A host's pages are its rows; rows of one doc_id count once for a line (all rows
    without doc_id are one). With ``copies_once`` pages are the distinct texts of a host
    (null texts are one), so that a document with many exact copies is not taken for
    boilerplate. A null host is a host of its own; null texts stay null; a text whose
    lines all go becomes empty; rows of one doc_id lose the same lines. An empty table
    gives no rows; columns may have any names.

    Lines are counted by a 128-bit hash of host and line, combined on the map side, so a
    host with a third of all rows is not gathered anywhere; that two of 10**12 lines share
    a hash has odds of about 1 in 10**15. Only the hashes of dropped lines return to the
    pages, one set for each doc_id. Texts of pages without dropped lines are not shuffled
    where the others are ``few``; beyond, one join shuffles all.
    """
    id_, site_, page_, line_, key_, n_, drop_ = unused(docs, "id", "site", "page", "line", "key", "n", "drop")
    site = F.coalesce(F.col(host).cast("string"), F.lit("\x00"))
    hashed = lambda line: F.struct(F.xxhash64(site, line).alias("a"), F.xxhash64(line, F.lit(1), site).alias("b"))
    page = F.xxhash64(site, "text") if copies_once else F.struct("doc_id")
    exploded = docs.select(F.col("doc_id").alias(id_), F.col(host), site.alias(site_), page.alias(page_), F.explode(F.array_distinct(F.split("text", "\n"))).alias(line_))
    lines = exploded.where(F.trim(line_) != "").select(id_, site_, page_, hashed(F.col(line_)).alias(key_))
    pages = docs.select(site.alias(site_), page.alias(page_)).groupBy(site_).agg((F.count_distinct(page_) if copies_once else F.count("*")).alias("pages"))
    counts = lines.groupBy(site_, key_).agg(F.count_distinct(page_).alias(n_)).where(F.col(n_) >= min_pages)
    common = counts.join(pages, site_).where(F.col(n_) > max_share * F.col("pages")).select(key_)
    hits = lines.join(common, key_, "left_semi").groupBy(id_).agg(F.collect_set(key_).alias(drop_))
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(drop_, hashed(x))), "\n")
    text = F.when(F.col(drop_).isNull(), F.col("text")).otherwise(kept)
    hits = cut(hits)
    same = F.col("doc_id").eqNullSafe(F.col(id_))
    cleaned = lambda some: some.join(hits, same, "left").select(*(text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns))
    if hits.count() > few:
        return cleaned(docs)
    with_hits = F.broadcast(hits.select(id_))
    return docs.join(with_hits, same, "left_anti").unionByName(cleaned(docs.join(with_hits, same, "left_semi")))


#: DuckDB SQL of the same rule over a view or subquery ``{docs}`` of documents.
SQL = """SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE array_to_string(list_filter(string_split(d.text, chr(10)),
  lambda x: NOT coalesce(list_contains(h.dropped, x), false)), chr(10)) END AS text, d.lang, d.source, d.n_chars
 FROM {docs} d LEFT JOIN (SELECT doc_id, list(line) AS dropped FROM (
  SELECT doc_id, line, count(*) OVER (PARTITION BY source, line) AS n, pages FROM (
   SELECT DISTINCT d.doc_id, d.source, p.pages, unnest(string_split(d.text, chr(10))) AS line FROM {docs} d
   JOIN (SELECT source, count(*) AS pages FROM {docs} GROUP BY source) p ON d.source IS NOT DISTINCT FROM p.source) l
  WHERE trim(line, ' ') <> '') c WHERE n >= 3 AND n > 0.05 * pages GROUP BY doc_id) h ON d.doc_id = h.doc_id"""
