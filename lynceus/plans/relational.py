"""Catalogue: digests, metrics, aggregates, merges, filters, windows, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lynceus.operators import digest, evaluate, filters, merge, normalize, triplets
from lynceus.plans.common import CVES, RUNS, TRIPLETS, query, rows, table
from lynceus.streaming import incremental

START, END = "1999-03-01", "1999-04-01"
_KEV_IN = f"is_kev AND kev_date_added >= DATE '{START}' AND kev_date_added < DATE '{END}'"
_WINDOW = f"vuln_status <> 'REJECTED' AND ((last_modified >= TIMESTAMP '{START}' AND last_modified < TIMESTAMP '{END}') OR ({_KEV_IN}))"
_TIER = f"CASE WHEN is_kev AND kev_ransomware_use = 'Known' THEN 1 WHEN {_KEV_IN} THEN 2 WHEN has_exploit_ref AND cvss_score >= 9 THEN 3 WHEN cvss_severity = 'CRITICAL' AND confidentiality_impact = 'HIGH' THEN 4 ELSE 5 END"
_REASON = "CASE tier WHEN 1 THEN 'KEV + known ransomware use' WHEN 2 THEN 'KEV added this week' WHEN 3 THEN 'public exploit reference + CVSS >= 9' WHEN 4 THEN 'CRITICAL severity with HIGH confidentiality impact' ELSE 'modified in window' END"


def _days(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in columns})


@query(
    f"SELECT cve_id, tier, {_REASON} AS tier_reason, cvss_score, strftime(kev_date_added, '%Y-%m-%d') AS kev_date_added FROM (SELECT *, {_TIER} AS tier FROM $cves WHERE {_WINDOW}) WHERE tier <= 4 "
    "ORDER BY tier, kev_date_added DESC NULLS LAST, cvss_score DESC NULLS LAST, exploitability_score DESC NULLS LAST, impact_score DESC NULLS LAST, last_modified DESC NULLS LAST, cve_id LIMIT 40",
    cves=CVES,
)
def dgs_top_tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(digest.top(rows(spark, sf_dir, CVES), START, END, limit=40), "kev_date_added").select("cve_id", "tier", "tier_reason", "cvss_score", "kev_date_added")


@query(
    f"SELECT count(*) AS total_modified, count(*) FILTER (published_date >= DATE '{START}' AND published_date < DATE '{END}') AS newly_published, count(*) FILTER (cvss_severity = 'CRITICAL') AS critical_count, "
    f"count(*) FILTER ({_KEV_IN}) AS kev_added_count, count(*) FILTER (is_kev AND kev_ransomware_use = 'Known') AS kev_ransomware_count, count(*) FILTER (has_exploit_ref) AS has_exploit_ref_count FROM $cves WHERE {_WINDOW}",
    cves=CVES,
)
def dgs_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.summary(rows(spark, sf_dir, CVES), START, END)


@query(
    f"SELECT cve_id, 2 AS tier, strftime(kev_date_added, '%Y-%m-%d') AS kev_date_added, kev_ransomware_use FROM $cves AS c WHERE vuln_status <> 'REJECTED' AND {_KEV_IN} "
    "ORDER BY c.kev_date_added DESC NULLS LAST, CASE WHEN kev_ransomware_use = 'Known' THEN 0 ELSE 1 END, cvss_score DESC NULLS LAST, exploitability_score DESC NULLS LAST, impact_score DESC NULLS LAST, cve_id LIMIT 15",
    cves=CVES,
)
def dgs_newly_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(digest.newly_added(rows(spark, sf_dir, CVES), START, END, limit=15), "kev_date_added").select("cve_id", "tier", "kev_date_added", "kev_ransomware_use")


@query(
    f"WITH t AS (SELECT cve_id, tier FROM (SELECT *, {_TIER} AS tier FROM $cves WHERE {_WINDOW}) WHERE tier <= 4 ORDER BY tier, kev_date_added DESC NULLS LAST, cvss_score DESC NULLS LAST, exploitability_score DESC NULLS LAST, impact_score DESC NULLS LAST, last_modified DESC NULLS LAST, cve_id LIMIT 20), "
    f"n AS (SELECT cve_id, 2 AS tier FROM $cves WHERE vuln_status <> 'REJECTED' AND {_KEV_IN} ORDER BY kev_date_added DESC NULLS LAST, CASE WHEN kev_ransomware_use = 'Known' THEN 0 ELSE 1 END, cvss_score DESC NULLS LAST, exploitability_score DESC NULLS LAST, impact_score DESC NULLS LAST, cve_id LIMIT 20) "
    "SELECT cve_id, tier, 0 AS list FROM t UNION ALL SELECT cve_id, tier, 1 FROM n WHERE cve_id NOT IN (SELECT cve_id FROM t)",
    cves=CVES,
)
def dgs_brief_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    cves = rows(spark, sf_dir, CVES)
    return digest.brief_items(digest.top(cves, START, END, limit=20), digest.newly_added(cves, START, END, limit=20))


@query("SELECT (SELECT count(*) FROM orders) AS cves, (SELECT count(*) FROM part) AS techniques, (SELECT count(*) FROM supplier) AS actors, (SELECT count(*) FROM documents) AS advisories")
def met_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.overview(cves=table(spark, sf_dir, "orders"), techniques=table(spark, sf_dir, "part"), actors=table(spark, sf_dir, "supplier"), advisories=table(spark, sf_dir, "documents"))


@query("SELECT upper(coalesce(cvss_severity, 'UNKNOWN')) AS severity, count(*) AS n FROM $cves GROUP BY 1", cves=CVES)
def met_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.severity_distribution(rows(spark, sf_dir, CVES))


@query("SELECT max(CASE WHEN source = 'signup' THEN completed_at END) AS nvd, max(CASE WHEN source = 'click' THEN completed_at END) AS kev, max(CASE WHEN source IN ('view', 'error') THEN completed_at END) AS attack, max(CASE WHEN source = 'none' THEN completed_at END) AS advisory FROM $runs", runs=RUNS)
def met_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.freshness(rows(spark, sf_dir, RUNS), {"nvd": ("signup",), "kev": ("click",), "attack": ("view", "error"), "advisory": ("none",)})


_LATER = "SELECT r.*, started_at + to_microseconds(event_id * 1700000 % 100000000) AS done FROM $runs r"


@query(
    f"SELECT run_id, source, CAST(epoch(date_trunc('second', done)) - epoch(date_trunc('second', started_at)) AS BIGINT) AS duration_s FROM ({_LATER}) ORDER BY started_at DESC, run_id LIMIT 25",
    runs=RUNS,
)
def met_recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = rows(spark, sf_dir, RUNS).withColumn("completed_at", F.expr("started_at + make_dt_interval(0, 0, 0, CAST(event_id * 1700000 % 100000000 AS DECIMAL(18,6)) / 1000000)"))
    return digest.recent_runs(runs, 25).select("run_id", "source", "duration_s")


@query("SELECT cve_id, cvss_score FROM $cves WHERE is_kev ORDER BY cvss_score DESC NULLS LAST, kev_date_added DESC NULLS LAST, cve_id LIMIT 10", cves=CVES)
def met_top_exploited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.top_exploited(rows(spark, sf_dir, CVES), 10).select("cve_id", "cvss_score")


_USAGE = "SELECT event_id AS log_id, event_type AS stage, concat('model-', CAST(user_id % 4 AS STRING)) AS model, event_id % 900 AS input_tokens, event_id % 130 AS output_tokens, ts AS created_at FROM {events}"
_COST = "SELECT u.*, CAST(CASE model WHEN 'model-0' THEN (input_tokens * 3 + output_tokens * 15) WHEN 'model-1' THEN (input_tokens * 1 + output_tokens * 5) WHEN 'model-2' THEN (input_tokens * 2 + output_tokens * 8) END AS DECIMAL(18,6)) / 1000000 AS cost FROM $usage u"


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = spark.createDataFrame([("model-0", 3, 15), ("model-1", 1, 5), ("model-2", 2, 8)], "model string, input_price int, output_price int")
    return digest.estimated_cost(rows(spark, sf_dir, _USAGE), prices)


@query(f"SELECT log_id, model, round(CAST(cost AS DOUBLE), 6) AS cost_usd FROM ({_COST})", usage=_USAGE)
def met_cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _usage(spark, sf_dir).select("log_id", "model", F.round(F.col("estimated_cost_usd").cast("double"), 6).alias("cost_usd"))


@query(
    f"SELECT stage, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(CAST(sum(cost) AS DOUBLE), 6) AS cost_usd, min(created_at) AS first_call, max(created_at) AS last_call FROM ({_COST}) GROUP BY stage",
    usage=_USAGE,
)
def met_cost_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.cost_by_stage(_usage(spark, sf_dir)).withColumn("cost_usd", F.round(F.col("cost_usd").cast("double"), 6))


@query(f"SELECT strftime(created_at, '%Y-%m-%d') AS day, round(CAST(sum(cost) AS DOUBLE), 6) AS spent FROM ({_COST}) GROUP BY 1", usage=_USAGE)
def met_spent_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(digest.spent_by_day(_usage(spark, sf_dir)), "day").withColumn("spent", F.round(F.col("spent").cast("double"), 6))


@query(f"SELECT round(CAST(coalesce(sum(cost), 0) AS DOUBLE), 6) AS spent, coalesce(sum(cost), 0) < 0.3 AS allowed FROM ({_COST}) WHERE CAST(created_at AS DATE) = DATE '2024-01-03'", usage=_USAGE)
def met_budget_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.within_budget(_usage(spark, sf_dir), "2024-01-03", 0.3).withColumn("spent", F.round(F.col("spent").cast("double"), 6))


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id")
def agg_listagg_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.joined_text(table(spark, sf_dir, "conversations"), "conv_id", "text", "turn")


@query("SELECT source, count(*) AS chunks, count(lang) AS with_lang, count(DISTINCT lang) AS langs, CAST(round(avg(n_chars)) AS INTEGER) AS mean_chars, max(n_chars) AS max_chars FROM documents GROUP BY source")
def agg_chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("chunks"), F.count("lang").alias("with_lang"), F.countDistinct("lang").alias("langs"), F.round(F.avg("n_chars")).cast("int").alias("mean_chars"), F.max("n_chars").alias("max_chars"))


@query("SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS tokens FROM lineitem GROUP BY l_orderkey HAVING sum(CAST(l_quantity AS BIGINT)) BETWEEN 100 AND 150")
def agg_token_sum_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("tokens")).where(F.col("tokens").between(100, 150))


_CHUNKS = "SELECT source AS document_type, n_chars AS token_count, CASE WHEN doc_id % 3 = 0 THEN lang END AS sub_section FROM {documents}"


@query("SELECT document_type, count(*) AS chunks, round(avg(token_count), 4) AS mean_tokens, CAST(median(token_count) AS DOUBLE) AS median_tokens, max(token_count) AS max_tokens, round(avg(CASE WHEN sub_section IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS sub_section_rate FROM $chunks GROUP BY 1", chunks=_CHUNKS)
def agg_chunk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.chunk_report(rows(spark, sf_dir, _CHUNKS))


@query("SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'de') AS de FROM documents WHERE lang IN ('en', 'fr', 'de') GROUP BY source")
def agg_pivot_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "documents").where(F.col("lang").isin("en", "fr", "de")).groupBy("source").pivot("lang", ["en", "fr", "de"]).count()
    return counts.na.fill(0)


@query("SELECT lang, arg_max(doc_id, n_chars * 1000000 - doc_id) AS longest FROM documents GROUP BY lang")
def agg_idxmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.max_by("doc_id", F.col("n_chars") * 1000000 - F.col("doc_id")).alias("longest"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3")
def agg_most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "event_type").limit(3)


@query("SELECT strftime(coalesce(CAST(max(last_modified) AS DATE), DATE '2000-01-01'), '%Y-%m-%d') AS start FROM $cves", cves=CVES)
def agg_cold_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(digest.cold_start(rows(spark, sf_dir, CVES)), "start")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedup_min_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triplets.without_repeats(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id")


# -- keyed writes --

_TARGET = "SELECT c_custkey AS k, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM {customer} WHERE c_custkey % 3 <> 0"
_BATCH = "SELECT c_custkey AS k, concat('new ', c_name) AS name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal + 1 END AS balance, c_mktsegment AS segment, c_custkey % 2 AS seq FROM {customer} WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'late', c_acctbal, 'none', 9 FROM {customer} WHERE c_custkey % 10 = 0"
_LAST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS r FROM $batch) WHERE r = 1)"


@query(f"SELECT coalesce(t.k, s.k) AS k, CASE WHEN s.k IS NOT NULL THEN s.name ELSE t.name END AS name, CASE WHEN s.k IS NOT NULL THEN s.balance ELSE t.balance END AS balance, t.segment FROM $target t FULL OUTER JOIN {_LAST} s ON t.k = s.k", target=_TARGET, batch=_BATCH)
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.upsert(rows(spark, sf_dir, _TARGET), rows(spark, sf_dir, _BATCH), ["k"], owned=["name", "balance"], order=["seq"])


@query(f"SELECT t.k, CASE WHEN s.k IS NOT NULL THEN s.name ELSE t.name END AS name, t.balance, t.segment FROM $target t LEFT JOIN {_LAST} s ON t.k = s.k", target=_TARGET, batch=_BATCH)
def merge_update_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.update_only(rows(spark, sf_dir, _TARGET), rows(spark, sf_dir, _BATCH), ["k"], owned=["name"], order=["seq"])


@query(f"SELECT * FROM $target UNION ALL SELECT k, name, balance, segment FROM {_LAST} WHERE k NOT IN (SELECT k FROM $target)", target=_TARGET, batch=_BATCH)
def merge_insert_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.insert_only(rows(spark, sf_dir, _TARGET), rows(spark, sf_dir, _BATCH), ["k"], order=["seq"])


_QUEUE = "SELECT c_custkey AS k, c_custkey % 4 = 1 AS fetched, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal END AS balance FROM {customer} WHERE c_custkey % 6 IN (0, 1)"


@query(
    f"SELECT coalesce(q.k, s.k) AS k, CASE WHEN s.k IS NOT NULL THEN FALSE ELSE q.fetched END AS fetched, coalesce(s.balance, q.balance) AS balance FROM $queue q FULL OUTER JOIN (SELECT * FROM {_LAST} WHERE k NOT IN (SELECT k FROM $target)) s ON q.k = s.k",
    queue=_QUEUE, target=_TARGET, batch=_BATCH,
)
def merge_coalesce_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.enqueue(rows(spark, sf_dir, _QUEUE), rows(spark, sf_dir, _BATCH), rows(spark, sf_dir, _TARGET), ["k"], values=["balance"], order=["seq"])


@query(
    "SELECT coalesce(t.k, a.k) AS k, CASE WHEN a.k IS NOT NULL THEN a.name ELSE t.name END AS name, CASE WHEN a.k IS NOT NULL THEN a.balance ELSE t.balance END AS balance FROM (SELECT k, name, balance FROM $target) t FULL OUTER JOIN "
    "(SELECT b.k, b.name, q.balance FROM (SELECT DISTINCT k, name FROM $batch WHERE seq <> 9) b JOIN $queue q ON b.k = q.k WHERE NOT coalesce(q.fetched, FALSE)) a ON t.k = a.k",
    queue=_QUEUE, target=_TARGET, batch=_BATCH,
)
def merge_drain_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrivals = rows(spark, sf_dir, _BATCH).where("seq <> 9").select("k", "name", "balance").dropDuplicates(["k"])
    return merge.drain(rows(spark, sf_dir, _QUEUE), arrivals, rows(spark, sf_dir, _TARGET).drop("segment"), ["k"], overlay=["balance"])[0]


@query("SELECT t.k, t.k IN (SELECT k FROM $batch WHERE balance IS NOT NULL) AS dirty FROM $target t", target=_TARGET, batch=_BATCH)
def merge_mark_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = rows(spark, sf_dir, _TARGET).select("k").withColumn("dirty", F.lit(False))
    return merge.mark(target, rows(spark, sf_dir, _BATCH), ["k"], "dirty", only=F.col("balance").isNotNull())


@query("SELECT count(*) FILTER (k IN (SELECT k FROM $target)) AS matched, count(*) FILTER (k NOT IN (SELECT k FROM $target)) AS missing FROM (SELECT DISTINCT k FROM $batch)", target=_TARGET, batch=_BATCH)
def merge_matched_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.matched_counts(rows(spark, sf_dir, _BATCH), rows(spark, sf_dir, _TARGET), ["k"])


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id % 3 <> 0 UNION ALL SELECT conv_id, turn + 100, NULL FROM conversations WHERE conv_id % 3 = 0")
def merge_replace_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    fresh = all_.where("conv_id % 3 = 0").select("conv_id", (F.col("turn") + 100).alias("turn"))
    return merge.replace_children(all_, fresh, ["conv_id"])


@query("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1")
def merge_key_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lynceus.schemas import duplicates

    return duplicates(table(spark, sf_dir, "customer"), "c_nationkey")


# -- filters and joins --

_ARRAYS = "SELECT l_orderkey AS advisory_id, collect_set(CAST(l_partkey % 50 AS STRING)) AS ids FROM {lineitem} GROUP BY l_orderkey"


@query("SELECT DISTINCT l_orderkey AS advisory_id FROM lineitem WHERE l_partkey % 50 IN (7, 11, 13)")
def flt_array_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, _ARRAYS).where(filters.overlaps(F.col("ids"), ["7", "11", "13"])).select("advisory_id")


@query("SELECT l_orderkey AS advisory_id, string_agg(DISTINCT CAST(l_partkey % 50 AS VARCHAR), ',' ORDER BY CAST(l_partkey % 50 AS VARCHAR)) AS matched FROM lineitem WHERE l_partkey % 50 IN (7, 11, 13) GROUP BY 1")
def jon_flatten_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.array(*[F.lit(x) for x in ("7", "11", "13")])
    hit = F.array_sort(F.array_intersect("ids", wanted))
    return rows(spark, sf_dir, _ARRAYS).where(F.size(hit) > 0).select("advisory_id", F.array_join(hit, ",").alias("matched"))


@query("SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey FROM lineitem l WHERE l.l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT')) AND l.l_returnflag IN ('R') AND l.l_partkey IN (3, 5, 7, 11, 13, 17, 19, 23)")
def flt_metadata_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_returnflag": "section_name"})
    parents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("document_type"))
    found = filters.metadata(chunks, parents, parent="l_orderkey", document_types=["1-URGENT"], section_names=["R"]).where(F.col("l_partkey").isin(3, 5, 7, 11, 13, 17, 19, 23))
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def flt_in_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def flt_not_in_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("doc_id is not null"), "doc_id", "left_anti").select("doc_id")


@query("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)")
def flt_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(big, "c_custkey", "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
def flt_not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(big, "c_custkey", "left_anti").select("c_custkey")


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars BETWEEN 200 AND 900 AND lang IS NOT NULL")
def flt_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.col("n_chars").between(200, 900) & F.col("lang").isNotNull()).select("doc_id", "n_chars")


@query("SELECT p_partkey FROM part WHERE lower(p_brand) = lower('BRAND#7') OR contains(lower(p_name), lower('WIDGET'))")
def flt_case_insensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(filters.same_text(F.col("p_brand"), F.lit("BRAND#7")) | filters.contains_text(F.col("p_name"), F.lit("WIDGET"))).select("p_partkey")


_NAMES = "SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN concat('10.0.', CAST(s_suppkey % 250 AS STRING), '.7') WHEN 1 THEN 'deadbeefdeadbeef01' WHEN 2 THEN 'ab' WHEN 3 THEN s_name ELSE concat(' ', s_name, ' ') END AS name FROM {supplier}"


@query("SELECT s_suppkey, trim(name) AS name FROM $names WHERE length(trim(name)) >= 3 AND NOT regexp_matches(trim(name), '^([0-9]{1,3}[.]){3}[0-9]{1,3}$$') AND NOT regexp_matches(trim(name), '^[0-9a-fA-F]{16,}$$')", names=_NAMES)
def flt_named_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, _NAMES).where(filters.named_entity(F.col("name"))).select("s_suppkey", F.trim("name").alias("name"))


@query("SELECT l_orderkey, l_linenumber, o_orderdate, l_partkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice > 450000")
def jon_inner_equi(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "orders").where("o_totalprice > 450000").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return table(spark, sf_dir, "lineitem").join(parents, "l_orderkey").select("l_orderkey", "l_linenumber", "o_orderdate", "l_partkey", "l_suppkey")


@query("SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON c_custkey = o_custkey")
def jon_left_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "customer").join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n, (SELECT string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS keys FROM customer WHERE c_custkey % 7 = 0")
def jon_correlated_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").alias("keys"))
    return table(spark, sf_dir, "customer").where("c_custkey % 7 = 0").join(per, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), "keys")


@query("SELECT p.p_partkey, coalesce(n.n_name, 'Unknown') AS parent FROM part p LEFT JOIN nation n ON p.p_size = n.n_nationkey")
def jon_default_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("p_size"), F.col("n_name").alias("parent"))
    return table(spark, sf_dir, "part").join(names, "p_size", "left").select("p_partkey", F.coalesce("parent", F.lit("Unknown")).alias("parent"))


_ALIASES = "SELECT DISTINCT upper(p_brand) AS alias_name, concat('Maker ', substr(p_brand, 7)) AS canonical_name FROM {part} WHERE p_size % 2 = 0 UNION SELECT DISTINCT p_type, concat('Type ', p_type) FROM {part} WHERE p_type LIKE '%O%'"
_NAMED = "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN lower(p_brand) ELSE p_brand END AS subject, p_type AS object FROM {part}"


@query("SELECT p_partkey, coalesce(a.canonical_name, subject) AS subject, coalesce(b.canonical_name, object) AS object FROM $named LEFT JOIN $aliases a ON lower(subject) = lower(a.alias_name) LEFT JOIN $aliases b ON lower(object) = lower(b.alias_name)", named=_NAMED, aliases=_ALIASES)
def jon_alias_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triplets.apply_aliases(rows(spark, sf_dir, _NAMED), rows(spark, sf_dir, _ALIASES))


@query("SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS triplet_id, alias_name FROM $named JOIN $aliases a ON (lower(subject) = lower(alias_name) OR lower(object) = lower(alias_name)) AND lower(alias_name) <> lower(canonical_name)", named=_NAMED, aliases=_ALIASES)
def jon_alias_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triplets.alias_leaks(rows(spark, sf_dir, _NAMED).withColumn("triplet_id", F.col("p_partkey").cast("string")), rows(spark, sf_dir, _ALIASES))


# -- windows, order, sets --


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def win_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.first_by_key(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def win_dedup_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.last_by_key(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id")


@query("SELECT p_brand, p_partkey, running FROM (SELECT *, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM part) WHERE running - p_size < 200")
def win_running_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.running_until(table(spark, sf_dir, "part"), "p_size", 200, "p_partkey", "p_brand").select("p_brand", "p_partkey", "running")


@query("SELECT advisory_id, subject, relation, object, concat(advisory_id, '_', lpad(CAST(row_number() OVER (PARTITION BY advisory_id ORDER BY ordinal) - 1 AS VARCHAR), 3, '0')) AS triplet_id FROM $t", t=TRIPLETS)
def win_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triplets.numbered(rows(spark, sf_dir, TRIPLETS), "advisory_id", "ordinal").drop("ordinal")


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 5")
def win_top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("lang").orderBy(F.col("n_chars").desc(), "doc_id")
    return table(spark, sf_dir, "documents").withColumn("r", F.row_number().over(order)).where("r <= 5").select("lang", "doc_id")


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256(concat('42|', doc_id)), doc_id) AS n FROM documents) WHERE n <= 20")
def win_quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.quota_sample(table(spark, sf_dir, "documents"), "lang", 20, "doc_id", seed=42).select("lang", "doc_id")


@query("SELECT c_custkey, c_name FROM customer ORDER BY lower(c_name), c_custkey LIMIT 30 OFFSET 10")
def srt_limit_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").orderBy(F.lower("c_name"), "c_custkey").offset(10).limit(30)


@query("SELECT trim(n_name) AS name FROM nation UNION SELECT trim(r_name) FROM region UNION SELECT trim(subject) FROM $t WHERE trim(subject) <> ''", t=TRIPLETS)
def set_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "nation").select(F.col("n_name").alias("subject"), F.lit("").alias("object")).unionByName(table(spark, sf_dir, "region").select(F.lit("").alias("subject"), F.col("r_name").alias("object")))
    return triplets.entity_names(pairs.unionByName(rows(spark, sf_dir, TRIPLETS).select("subject", F.lit(" ").alias("object"))))


@query("SELECT s_nationkey AS k FROM supplier EXCEPT SELECT c_nationkey FROM customer WHERE c_custkey % 50 = 0")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")).subtract(table(spark, sf_dir, "customer").where("c_custkey % 50 = 0").select("c_nationkey"))


@query("SELECT l_partkey AS k FROM lineitem WHERE l_orderkey % 100 = 0 INTERSECT SELECT p_partkey FROM part WHERE p_size < 20")
def set_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_orderkey % 100 = 0").select(F.col("l_partkey").alias("k")).intersect(table(spark, sf_dir, "part").where("p_size < 20").select("p_partkey"))


_MAPPED = "SELECT concat('CVE-2020-', CAST(l_orderkey AS STRING)) AS cve_id, collect_list(CASE WHEN l_partkey % 9 = 0 THEN '' ELSE concat('CWE-', CAST(l_partkey % 30 AS STRING)) END) AS cwe_ids FROM {lineitem} WHERE l_orderkey % 10 = 0 GROUP BY l_orderkey"


@query("SELECT DISTINCT concat('CVE-2020-', l_orderkey, '|CWE-', l_partkey % 30, '|nvd') AS mapping_id, concat('CVE-2020-', l_orderkey) AS cve_id, concat('CWE-', l_partkey % 30) AS cwe_id, 'nvd' AS source FROM lineitem WHERE l_orderkey % 10 = 0 AND l_partkey % 9 <> 0")
def set_weakness_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.weakness_mappings(rows(spark, sf_dir, _MAPPED))


# -- triplets --

_RELATIONS = "('uses', 'targets', 'exploits', 'mitigates', 'affects', 'attributed_to', 'has_weakness')"
_VAGUE = "(" + ", ".join(f"'{v}'" for v in filters.VAGUE) + ")"
_VERDICT = f"CASE WHEN trim(subject) = '' THEN 'empty subject' WHEN trim(object) = '' THEN 'empty object' WHEN relation NOT IN {_RELATIONS} THEN 'relation' WHEN lower(trim(subject)) IN {_VAGUE} THEN 'vague subject' WHEN lower(trim(object)) IN {_VAGUE} THEN 'vague object' END"


@query(f"SELECT ordinal, subject, relation, object, {_VERDICT} AS reason FROM $t WHERE {_VERDICT} IS NOT NULL", t=TRIPLETS)
def val_triplet_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triplets.validate(rows(spark, sf_dir, TRIPLETS))[1].drop("advisory_id")


@query(f"SELECT count(*) AS n, count({_VERDICT}) AS rejected, round(CAST(count({_VERDICT}) AS DOUBLE) / count(*), 6) AS rate FROM $t", t=TRIPLETS)
def evl_rejection_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triplets.rejection_rate(rows(spark, sf_dir, TRIPLETS))


@query("SELECT min(ordinal) AS ordinal FROM $t GROUP BY lower(trim(subject)), relation, lower(trim(object))", t=TRIPLETS)
def val_triplet_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triplets.first_of_each(rows(spark, sf_dir, TRIPLETS)).select("ordinal")


_PAIRS = "SELECT concat('n', CAST(c_custkey AS STRING)) AS a, concat('n', CAST(c_custkey * 7 % 900 AS STRING)) AS b, CAST(c_custkey % 97 AS DOUBLE) / 97 AS score, c_custkey % 3 <> 0 AS same, CASE c_custkey % 4 WHEN 0 THEN 'third' WHEN 1 THEN concat('n', CAST(c_custkey AS STRING)) ELSE concat('n', CAST(c_custkey * 7 % 900 AS STRING)) END AS canonical, 'actor' AS type_a, 'software' AS type_b FROM {customer}"


@query(
    "SELECT alias_name, canonical_name, entity_type FROM (SELECT *, row_number() OVER (PARTITION BY alias_name ORDER BY score DESC, canonical_name) AS r FROM "
    "(SELECT CASE WHEN canonical = a THEN b ELSE a END AS alias_name, canonical AS canonical_name, CASE WHEN canonical = a THEN type_a ELSE type_b END AS entity_type, score FROM $pairs WHERE same)) WHERE r = 1",
    pairs=_PAIRS,
)
def val_alias_approval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triplets.approve(rows(spark, sf_dir, _PAIRS))


# -- incremental --


@query("SELECT strftime(CAST(d AS DATE), '%Y-%m-%d') AS slice_start, strftime(least(CAST(d AS DATE) + 6, e), '%Y-%m-%d') AS slice_end FROM (SELECT unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 7 DAY)) AS d, CAST(max(o_orderdate) AS DATE) AS e FROM orders)")
def str_slice_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = table(spark, sf_dir, "orders").agg(F.min("o_orderdate").cast("date").alias("start"), F.max("o_orderdate").cast("date").alias("end"))
    return _days(incremental.slice_rows(bounds), "slice_start", "slice_end")


_CHECKPOINTS = "SELECT concat('s', CAST(c_custkey AS STRING)) AS source, CAST(o_orderdate AS DATE) AS last_watermark, CASE WHEN c_custkey % 2 = 0 THEN 'old' END AS notes FROM {customer} JOIN (SELECT o_custkey, max(o_orderdate) AS o_orderdate FROM {orders} GROUP BY o_custkey) ON c_custkey = o_custkey WHERE c_custkey % 3 = 0"
_MOVES = "SELECT concat('s', CAST(c_custkey AS STRING)) AS source, CASE WHEN c_custkey % 5 <> 0 THEN DATE '2002-01-01' END AS last_watermark, CASE WHEN c_custkey % 7 = 0 THEN 'new' END AS notes FROM {customer} WHERE c_custkey % 4 = 0"


@query("SELECT coalesce(s.source, t.source) AS source, strftime(coalesce(s.last_watermark, t.last_watermark), '%Y-%m-%d') AS last_watermark, coalesce(s.notes, t.notes) AS notes FROM $t t FULL OUTER JOIN $s s ON s.source = t.source", t=_CHECKPOINTS, s=_MOVES)
def str_watermark_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(incremental.advance(rows(spark, sf_dir, _CHECKPOINTS), rows(spark, sf_dir, _MOVES)), "last_watermark")


_DONE = "SELECT concat('run', CAST(event_id AS STRING)) AS run_id, 'done' AS status, CASE WHEN event_id % 4 = 0 THEN event_id END AS user_id FROM {events} WHERE event_id % 3 = 0"


@query("SELECT t.run_id, coalesce(s.status, t.status) AS status, coalesce(s.user_id, t.user_id) AS user_id FROM $t t LEFT JOIN $s s ON t.run_id = s.run_id", t=RUNS, s=_DONE)
def str_run_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.complete_run(rows(spark, sf_dir, RUNS).select("run_id", "status", "user_id"), rows(spark, sf_dir, _DONE))


@query("SELECT cve_id FROM $cves WHERE NOT coalesce(CASE WHEN o_orderkey % 2 = 0 THEN is_kev END, FALSE)", cves=CVES)
def str_unsynced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.unsynced(rows(spark, sf_dir, CVES).withColumn("mark", F.when(F.col("o_orderkey") % 2 == 0, F.col("is_kev"))), "mark").select("cve_id")
