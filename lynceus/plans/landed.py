"""Catalogue: feeds and pages read from landed files, and what is written back.

Each query writes its files to the session's shared folder first, so that the
reader is the one that is used on real feeds.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lynceus import schemas
from lynceus.operators import merge, normalize, search, sections
from lynceus.plans.common import CVES, query, rows, rows_dealt, table
from lynceus.plans.documents import _ID, _RAW, _STIX, _stix
from lynceus.session import shared_folder
from lynceus.sources import feeds, tables
from lynceus.streaming import incremental


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/landed-{uuid.uuid4().hex}"


def _text(df: DataFrame, column: str) -> str:
    """One line a row."""
    path = _folder(df.sparkSession)
    df.select(F.col(column).alias("value")).write.text(path)
    return path


def _whole(df: DataFrame, head: str, item: str, tail: str, between: str = ",", order: str = "ordinal") -> str:
    """All rows' items as one document."""
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, item))), lambda x: x[item]), between)
    return _text(df.agg(F.concat(F.lit(head), parts, F.lit(tail)).alias("value")).coalesce(1), "value")


# -- vulnerability feeds --

_LINES = f"SELECT CASE WHEN o_orderkey % 40 = 1 THEN 'not a line' WHEN o_orderkey % 40 = 2 THEN '  ' ELSE line END AS line FROM ({_RAW})"
_GOOD = "o_orderkey % 40 NOT IN (1, 2)"
_DAY = "strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d')"


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.ndjson(spark, _text(rows(spark, sf_dir, _LINES), "line"))


@query(f"SELECT {_ID} AS cve_id, concat({_DAY}, 'T10:15:00.000') AS published, NULL AS bad FROM orders WHERE {_GOOD} UNION ALL SELECT NULL, NULL, 'not a line' FROM orders WHERE o_orderkey % 40 = 1")
def src_ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feed(spark, sf_dir).select(F.col("cve.id").alias("cve_id"), F.col("cve.published").alias("published"), F.col("_bad").alias("bad"))


@query(f"SELECT {_ID} AS cve_id FROM orders WHERE {_GOOD} AND CAST(o_orderdate AS DATE) BETWEEN DATE '1995-03-01' AND DATE '1995-06-30'")
def src_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.changed_between(_feed(spark, sf_dir), dt.date(1995, 3, 1), dt.date(1995, 6, 30)).select(F.col("cve.id").alias("cve_id"))


@query(f"SELECT {_ID} AS cve_id, concat({_DAY}, 'T10:15:00.000') AS published FROM orders WHERE {_GOOD} AND {_ID} = 'CVE-2021-1005'")
def src_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.single(_feed(spark, sf_dir), " cve-2021-1005 ").select(F.col("cve.id").alias("cve_id"), F.col("cve.published").alias("published"))


@query("SELECT cve_id, strftime(published_date, '%Y-%m-%d') AS published_date, last_modified, cvss_score, is_kev, strftime(kev_date_added, '%Y-%m-%d') AS kev_date_added FROM $cves", cves=CVES)
def src_curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = schemas.conform(rows(spark, sf_dir, CVES), schemas.TABLES["cve_records"])
    found = feeds.curated(spark, _text(made.select(F.to_json(F.struct("*")).alias("line")), "line"))
    return found.select("cve_id", F.date_format("published_date", "yyyy-MM-dd").alias("published_date"), "last_modified", "cvss_score", "is_kev", F.date_format("kev_date_added", "yyyy-MM-dd").alias("kev_date_added"))


_YEAR = "o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' AND o_orderkey % 16 = 0"


@query(f"SELECT strftime(CAST(o_orderdate AS DATE), '%Y-%m') AS month, count(*) AS lines, min({_ID}) AS least FROM orders WHERE {_YEAR} GROUP BY 1")
def src_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    per_month = rows(spark, sf_dir, f"SELECT date_format(o_orderdate, 'yyyy-MM') AS month, line FROM (SELECT r.line, o.o_orderdate FROM ({_RAW}) r JOIN {{orders}} o ON r.o_orderkey = o.o_orderkey WHERE {_YEAR.replace('o_orderkey', 'o.o_orderkey')})")
    for month, lines in per_month.groupBy("month").agg(F.array_join(F.collect_list("line"), "\n")).collect():  # twelve files
        tables._save(spark, f"{path}/{month}.jsonl", lines)
    tables._save(spark, f"{path}/readme.txt", "no feed")
    return feeds.monthly(spark, path).groupBy("month").agg(F.count("*").alias("lines"), F.min("cve.id").alias("least"))


@query("SELECT o_comment AS value FROM (SELECT CASE WHEN o_orderkey % 9 = 0 THEN ' ' ELSE concat('line ', o_orderkey) END AS o_comment FROM orders) WHERE trim(o_comment) <> ''")
def src_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = rows(spark, sf_dir, "SELECT CASE WHEN o_orderkey % 9 = 0 THEN ' ' ELSE concat('line ', CAST(o_orderkey AS STRING)) END AS line FROM {orders}")
    return feeds.lines(spark, _text(made, "line"))


# -- other documents --

_LISTED = "SELECT p_partkey AS ordinal, concat('CVE-2022-', CAST(p_partkey AS STRING)) AS cveID, '2022-05-06' AS dateAdded, CASE WHEN p_partkey % 3 = 0 THEN 'Known' ELSE 'Unknown' END AS knownRansomwareCampaignUse, p_brand AS vendorProject, p_name AS product FROM {part}"


@query("SELECT cveID, dateAdded, knownRansomwareCampaignUse, vendorProject, product, CAST(row_number() OVER (ORDER BY ordinal) - 1 AS INTEGER) AS ordinal FROM $k", k=_LISTED)
def src_exploited_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = rows(spark, sf_dir, _LISTED)
    path = _whole(made.select("ordinal", F.to_json(F.struct(*[c for c in made.columns if c != "ordinal"])).alias("item")), '{"title": "x", "vulnerabilities": [', "item", "]}")
    return feeds.exploited_list(spark, path).select("cveID", "dateAdded", "knownRansomwareCampaignUse", "vendorProject", "product", "ordinal")


@query("SELECT id, type, name, mitre AS external_id, source_ref, target_ref, relationship_type FROM $s", s=_STIX)
def src_stix_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _stix(spark, sf_dir)
    path = _whole(made.select(F.col("id").alias("ordinal"), F.to_json(F.struct("*")).alias("item")), '{"type": "bundle", "objects": [', "item", "]}")
    return feeds.stix_objects(spark, path).select("id", "type", "name", normalize.external_id(F.col("external_references")).alias("external_id"), "source_ref", "target_ref", "relationship_type")


_WEAK = "SELECT p_partkey AS ordinal, p_name AS name, p_type AS kind, CASE WHEN p_partkey % 5 = 0 THEN 'Deprecated' ELSE 'Draft' END AS status, p_brand AS brand FROM {part}"


@query("SELECT CAST(ordinal AS VARCHAR) AS CWE_ID, name AS Name, kind AS Abstraction, status AS Status, concat('about ', brand, ' things') AS Description FROM $w", w=_WEAK)
def src_weaknesses_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.format_string('<Weakness ID="%d" Name="%s" Abstraction="%s" Status="%s"><Description> about <b>%s</b> things </Description></Weakness>', "ordinal", "name", "kind", "status", "brand")
    made = rows(spark, sf_dir, _WEAK).select("ordinal", item.alias("item"))
    return feeds.weaknesses_xml(spark, _whole(made, '<Weakness_Catalog xmlns="http://cwe.mitre.org/cwe-7"><Weaknesses>', "item", "</Weaknesses></Weakness_Catalog>", ""))


@query("SELECT CAST(ordinal AS VARCHAR) AS CWE_ID, name AS Name, kind AS Abstraction, status AS Status, brand AS Description FROM $w", w=_WEAK)
def src_weaknesses_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.to_json(F.struct(F.col("ordinal").cast("string").alias("ID"), F.col("name").alias("Name"), F.col("kind").alias("Abstraction"), F.col("status").alias("Status"), F.col("brand").alias("Description")))
    return feeds.weaknesses_json(spark, _whole(rows(spark, sf_dir, _WEAK).select("ordinal", item.alias("item")), '{"Weaknesses": [', "item", "]}"))


# -- advisories --

SITE = "https://example.org"
_KNOWN_ADVISORY = "p_partkey % 7 = 0"
_ADVISORY = "concat('aa', CAST(p_partkey AS STRING), '-x')"
_BODY = "concat('About ', p_name, ' and CVE-2021-', CAST(10000 + p_partkey AS STRING), '.')"
#: Teasers of a list page, one part each, some of another kind or without a time.
_TEASERS = f"""SELECT p_partkey AS ordinal, concat('<article class="c-teaser x"><time', CASE WHEN p_partkey % 11 = 0 THEN '' ELSE concat(' datetime="2024-0', CAST(1 + p_partkey % 9 AS STRING), '-15T12:00:00Z"') END, '></time><div class="c-teaser__meta">',
 CASE p_partkey % 3 WHEN 0 THEN 'Analysis Report' WHEN 1 THEN 'Cybersecurity Advisory' ELSE 'Alert' END, '</div><h3 class="c-teaser__title"><a href="', CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'https://archive.test/web/1/{SITE}' END, '/news/', {_ADVISORY}, '"> ', p_name, ' </a></h3></article>') AS item FROM {{part}}"""
_LISTED_ADVISORIES = f"SELECT {_ADVISORY} AS advisory_id, p_name AS title, concat('{SITE}/news/', {_ADVISORY}) AS url, CAST(concat('2024-0', CAST(1 + p_partkey % 9 AS STRING), '-15') AS DATE) AS published_date, CASE WHEN p_partkey % 3 = 0 THEN 'analysis_report' ELSE 'cybersecurity_advisory' END AS advisory_type, p_partkey FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 3 < 2"
_PAGES = f"SELECT {_ADVISORY} AS advisory_id, p_partkey, concat('<html><nav>menu</nav><main><p>Lead ', p_brand, '</p><h2>Executive Summary</h2><p>', {_BODY}, '</p><h2>Tags</h2><p>none</p><h2>Mitigations</h2><h3>Patch</h3><p>Patch ', p_type, '</p><script>x()</script></main></html>') AS html FROM {{part}}"


def _list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As on a site, more teasers make more pages and not longer ones."""
    made = rows(spark, sf_dir, _TEASERS)
    return made.groupBy(F.floor(F.col("ordinal") / 100).alias("page")).agg(F.concat(F.lit("<html><body>"), F.array_join(F.collect_list("item"), ""), F.lit("</body></html>")).alias("html"))


@query(f"SELECT advisory_id, title, url, strftime(published_date, '%Y-%m-%d') AS published_date, advisory_type FROM ({_LISTED_ADVISORIES})")
def src_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.listings(_list_pages(spark, sf_dir), SITE).withColumn("published_date", F.date_format("published_date", "yyyy-MM-dd"))


@query(f"SELECT advisory_id FROM ({_LISTED_ADVISORIES}) WHERE published_date >= DATE '2024-04-01' AND NOT ({_KNOWN_ADVISORY})")
def src_to_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = rows(spark, sf_dir, f"SELECT {_ADVISORY} AS advisory_id FROM {{part}} WHERE {_KNOWN_ADVISORY}")
    return feeds.to_fetch(feeds.listings(_list_pages(spark, sf_dir), SITE), known, dt.date(2024, 4, 1)).select("advisory_id")


@query(f"SELECT advisory_id AS key, sha256(html) AS digest FROM ({_PAGES.replace('{part}', 'part')}) WHERE p_partkey <= 12")
def src_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    for key, html in rows(spark, sf_dir, f"SELECT advisory_id, html FROM ({_PAGES}) WHERE p_partkey <= 12").collect():  # a dozen files
        tables._save(spark, f"{path}/{key}.html", html)
    return feeds.pages(spark, path).select("key", F.sha2("html", 256).alias("digest"))


_CUT = f"""SELECT advisory_id, ordinal, section_name, sub_section, text FROM (SELECT {_ADVISORY} AS advisory_id, 0 AS ordinal, 'Summary' AS section_name, NULL AS sub_section, concat('Lead ', p_brand) AS text FROM part
UNION ALL SELECT {_ADVISORY}, 1, 'Summary', NULL, {_BODY} FROM part UNION ALL SELECT {_ADVISORY}, 2, 'Mitigation', 'Patch', concat('Patch ', p_type) FROM part)"""


@query(f"SELECT advisory_id, CAST(ordinal AS INTEGER) AS ordinal, section_name, sub_section, text FROM ({_CUT})")
def doc_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.split(rows_dealt(spark, sf_dir, _PAGES), type_col=None)


@query(f"SELECT {_ADVISORY} AS advisory_id, CAST(0 AS INTEGER) AS ordinal, 'General' AS section_name, concat('Lead ', p_brand) AS text FROM part UNION ALL SELECT {_ADVISORY}, 1, 'Summary', {_BODY} FROM part UNION ALL SELECT {_ADVISORY}, 2, 'Mitigation', concat('Patch Patch ', p_type) FROM part")
def doc_flat_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.flat(rows_dealt(spark, sf_dir, _PAGES))


_PIECES = r"regexp_extract_all(text, '[0-9A-Za-z_]+|[^0-9A-Za-z_\s]')"
_CHUNKS = f"SELECT concat(advisory_id, '_', lpad(CAST(ordinal AS VARCHAR), 3, '0')) AS chunk_id, advisory_id, CAST(ordinal AS INTEGER) AS chunk_index, section_name, sub_section, text AS chunk_text, CAST(len({_PIECES}) AS INTEGER) AS token_count, sha256(text) AS content_hash, array_to_string(regexp_extract_all(text, 'CVE-[0-9]{{4}}-[0-9]{{4,7}}'), ',') AS cve_ids FROM ({_CUT})"


@query(_CHUNKS)
def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sections.chunks(rows_dealt(spark, sf_dir, _PAGES), type_col=None)
    return found.select("chunk_id", "advisory_id", "chunk_index", "section_name", "sub_section", "chunk_text", "token_count", "content_hash", F.array_join("cve_ids", ",").alias("cve_ids"))


@query(f"SELECT advisory_id, cve_ids AS cve_ids_mentioned, '' AS mitre_ids_mentioned FROM ({_CHUNKS}) WHERE chunk_index = 1 AND advisory_id NOT LIKE 'aa%5-x' UNION ALL SELECT {_ADVISORY}, 'old', 'kept' FROM part WHERE p_partkey % 10 = 5")
def snk_metadata_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = rows_dealt(spark, sf_dir, _PAGES)
    one = F.array(F.lit("old")), F.array(F.lit("kept"))
    target = pages.select("advisory_id", F.when(F.col("p_partkey") % 10 == 5, one[0]).alias("cve_ids_mentioned"), F.when(F.col("p_partkey") % 10 == 5, one[1]).alias("mitre_ids_mentioned"))
    noted = sections.mentions(sections.chunks(pages.where("p_partkey % 10 <> 5"), type_col=None))
    done = merge.backfill(target, noted, ["advisory_id"], ["cve_ids_mentioned", "mitre_ids_mentioned"])
    return done.select("advisory_id", *[F.array_join(c, ",").alias(c) for c in ("cve_ids_mentioned", "mitre_ids_mentioned")])


_TYPED = "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'MAR' END AS document_type, CASE WHEN p_partkey % 4 = 1 THEN '#StopRansomware: y' ELSE p_name END AS title, 'cybersecurity_advisory' AS advisory_type, CASE WHEN p_partkey % 4 = 2 THEN '<main><p>Seen by CISA</p><p>with the FBI</p></main>' ELSE '<main><p>Seen by CISA</p></main>' END AS html FROM {part}"


@query("SELECT document_type, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 4 = 0 THEN 'MAR' WHEN p_partkey % 4 = 1 THEN 'STOPRANSOMWARE' WHEN p_partkey % 4 = 2 THEN 'JOINT_CSA' ELSE 'CSA' END AS document_type FROM part) GROUP BY 1")
def prj_lazy_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = rows_dealt(spark, sf_dir, _TYPED).withColumnRenamed("p_partkey", "advisory_id").withColumn("co_authors", F.lit(None).cast("array<string>"))
    # a page is there twice, and an advisory stays one row
    pages = made.select("advisory_id", "html").unionByName(made.select("advisory_id", "html"))
    return sections.classified(made.drop("html"), pages).groupBy("document_type").agg(F.count("*").alias("n"))


def _embed(texts: list[str | None]) -> list[list[float]]:
    return [[float(len(t or "")), 1.0] for t in texts]


@query("SELECT p_partkey, CAST(CASE WHEN p_partkey % 3 = 0 THEN 7 ELSE length(p_name) END AS DOUBLE) AS v FROM part")
def txt_missing_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = rows(spark, sf_dir, "SELECT p_partkey, p_name AS chunk_text, CASE WHEN p_partkey % 3 = 0 THEN array(CAST(7 AS FLOAT), CAST(1 AS FLOAT)) END AS chunk_embedding FROM {part}")
    return search.missing_vectors(chunks, _embed, batch=20).select("p_partkey", F.get("chunk_embedding", F.lit(0)).cast("double").alias("v"))


# -- loads --


@query("SELECT p_brand AS name, count(*) AS n FROM part GROUP BY 1")
def snk_tsv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    tables.export_tsv(table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("n")), path)
    return spark.read.option("sep", "\t").option("header", True).schema("name STRING, n BIGINT").csv(path)


@query("SELECT r_regionkey, r_name, TRUE AS no_check, TRUE AS no_notes FROM region")
def snk_schema_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = schemas.evolve(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), "r_name STRING, checked BOOLEAN, notes STRING")
    twice = schemas.evolve(once, "r_name STRING, checked BOOLEAN, notes STRING")
    return twice.select("r_regionkey", "r_name", F.isnull("checked").alias("no_check"), F.isnull("notes").alias("no_notes"))


_EVENTS = "SELECT user_id, event_id, event_type, value FROM {events}"


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE user_id IS NOT NULL) WHERE n = 1")
def str_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that land in two goes, taken a few at a time into buckets."""
    made, base = rows(spark, sf_dir, _EVENTS), _folder(spark)
    empty = spark.createDataFrame([], made.schema)
    for part in (0, 1):
        made.where(F.col("event_id") % 2 == part).repartition(2).write.mode("append").json(f"{base}/in")
        incremental.load_stream(spark, f"{base}/in", made.schema, f"{base}/table", empty, ["user_id"], f"{base}/checkpoint", order=["event_id"], owned=["event_id", "event_type", "value"], transform=_newer(spark, f"{base}/table"), files_per_batch=2)
    return tables.read(spark, f"{base}/table").select("user_id", "event_id", "value")


def _newer(spark: SparkSession, target: str):
    """Leaves out what the table has a later event for."""

    def keep(batch: DataFrame) -> DataFrame:
        if not tables.exists(spark, target):
            return batch
        have = tables.read(spark, target).select("user_id", F.col("event_id").alias("_have"))
        return batch.join(have, "user_id", "left").where("_have is null or event_id > _have").drop("_have")

    return keep


@query(
    "SELECT run, CAST(coalesce(CAST(forced AS DATE), CASE WHEN watermark IS NOT NULL THEN CAST(watermark AS DATE) + 1 END, CAST(newest AS DATE), DATE '2000-01-01') AS VARCHAR) AS first, CAST(greatest(coalesce(CAST(forced AS DATE), CASE WHEN watermark IS NOT NULL THEN CAST(watermark AS DATE) + 1 END, CAST(newest AS DATE), DATE '2000-01-01'), DATE '2024-03-10') AS VARCHAR) AS last "
    "FROM (VALUES (1, NULL, NULL, NULL), (2, '2024-03-01', NULL, NULL), (3, NULL, '2023-12-31', NULL), (4, '2024-03-10', '2023-12-31', NULL), (5, '2024-03-01', NULL, '2024-02-02')) AS t(run, watermark, newest, forced)"
)
def str_resolve_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda x: None if x is None else dt.date.fromisoformat(x)
    runs = ((1, None, None, None), (2, "2024-03-01", None, None), (3, None, "2023-12-31", None), (4, "2024-03-10", "2023-12-31", None), (5, "2024-03-01", None, "2024-02-02"))
    found = [(n, *(d.isoformat() for d in incremental.resolve_window(dt.date(2024, 3, 10), day(w), day(m), day(f)))) for n, w, m, f in runs]
    return spark.createDataFrame(found, "run int, first string, last string")
