"""Catalogue: graph values and counts, attack tables, questions, evidence, usage."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lynceus import schemas
from lynceus.functions import text as T
from lynceus.operators import digest, evaluate, graph, merge, normalize, search, triplets
from lynceus.plans import answer
from lynceus.plans.common import CVES, EDGES, NODES, TRIPLETS, parts_of, query, rows, rows_dealt, table
from lynceus.plans.documents import _BM25, _index, _near_sql, _start, _trail, _paths_sql, _vectors
from lynceus.plans.landed import _ADVISORY, _BODY, _KNOWN_ADVISORY, _LISTED_ADVISORIES, _PAGES, SITE, _embed, _folder, _list_pages
from lynceus.plans.relational import END, START, _TIER, _REASON, _WINDOW

# -- attack tables --

_MORE = """SELECT concat('course-of-action--', CAST(p_partkey AS STRING)) AS id, 'course-of-action' AS type, p_name AS name, CASE WHEN p_partkey % 3 <> 0 THEN concat('M', CAST(p_partkey AS STRING)) END AS mitre, p_brand AS brand FROM {part}
UNION ALL SELECT concat('x-mitre-tactic--', CAST(n_nationkey AS STRING)), 'x-mitre-tactic', n_name, concat('TA', CAST(n_nationkey AS STRING)), lower(n_name) FROM {nation}
UNION ALL SELECT concat('campaign--', CAST(s_suppkey AS STRING)), 'campaign', s_name, CASE WHEN s_suppkey % 2 = 0 THEN concat('C', CAST(s_suppkey AS STRING)) END, s_name FROM {supplier}"""


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = rows_dealt(spark, sf_dir, _MORE)
    have = raw.withColumn("external_references", F.when(F.col("mitre").isNotNull(), F.array(F.struct(F.lit("mitre-attack").alias("source_name"), F.col("mitre").alias("external_id"))))).withColumn("description", F.repeat("brand", F.lit(600))).withColumn("x_mitre_shortname", F.col("brand")).withColumn("first_seen", F.lit("2020-01-02T00:00:00Z"))
    return have.select(*[(F.col(f.name) if f.name in have.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schemas.STIX)])


@query("SELECT mitre AS mitigation_id, id AS stix_id, name, left(repeat(brand, 600), 4000) AS description FROM $m WHERE type = 'course-of-action' AND mitre IS NOT NULL", m=_MORE)
def prj_mitigations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.mitigations(_objects(spark, sf_dir))


@query("SELECT mitre AS tactic_id, id AS stix_id, name, brand AS shortname FROM $m WHERE type = 'x-mitre-tactic'", m=_MORE)
def prj_tactics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.tactics(_objects(spark, sf_dir)).drop("tactic_order")


@query("SELECT coalesce(mitre, id) AS campaign_id, id AS stix_id, name, '2020-01-02' AS first_seen FROM $m WHERE type = 'campaign'", m=_MORE)
def prj_campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.campaigns(_objects(spark, sf_dir)).select("campaign_id", "stix_id", "name", F.date_format("first_seen", "yyyy-MM-dd").alias("first_seen"))


@query(
    "SELECT 'attack_techniques' AS name, 0 AS n, 0 AS renamed UNION ALL SELECT 'attack_actors', 0, 0 UNION ALL SELECT 'attack_relationships', 0, 0 "
    "UNION ALL SELECT 'attack_mitigations', count(*), count(*) FILTER (brand LIKE '%1') FROM $m WHERE type = 'course-of-action' AND mitre IS NOT NULL UNION ALL SELECT 'attack_tactics', count(*), count(*) FILTER (brand LIKE '%1') FROM $m WHERE type = 'x-mitre-tactic' UNION ALL SELECT 'attack_campaigns', count(*), count(*) FILTER (brand LIKE '%1') FROM $m WHERE type = 'campaign'",
    m=_MORE,
)
def snk_attack_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six tables loaded by their specifications, then again with some names changed."""
    objects = _objects(spark, sf_dir)
    parts = parts_of(table(spark, sf_dir, "part").count() + table(spark, sf_dir, "supplier").count(), 1)
    tables = merge.upsert_tables({}, normalize.attack_tables(objects), schemas.TABLES, parts)
    changed = objects.where("description like '%1'").withColumn("name", F.lit("renamed"))
    tables = merge.upsert_tables(tables, normalize.attack_tables(changed), schemas.TABLES, parts)
    counts = [t.agg(F.lit(n).alias("name"), F.count("*").alias("n"), F.count_if(F.col("name") == "renamed" if "name" in t.columns else F.lit(False)).alias("renamed")) for n, t in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


# -- graph --


@query("""SELECT label, key, concat('{"label":"', label, '","key":"', key, '","name":', CASE WHEN name IS NULL THEN 'null' ELSE concat('"', name, '"') END, ',"published_date":', CASE WHEN published_date IS NULL THEN 'null' ELSE concat('"', strftime(published_date, '%Y-%m-%d'), '"') END, ',"is_kev":', is_kev, '}') AS value FROM $n""", n=NODES)
def prj_graph_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, NODES).select("label", "key", T.json_row("label", "key", "name", "published_date", "is_kev").alias("value"))


@query("SELECT cve_id AS key, strftime(published_date, '%Y-%m-%d') AS published_date, strftime(last_modified, '%Y-%m-%dT%H:%M:%S') AS last_modified, left(repeat('word ', 8000), 28000) AS description, coalesce(has_exploit_ref, FALSE) AS has_exploit_ref, coalesce(is_kev, FALSE) AS is_kev FROM $c WHERE o_orderkey % 50 = 0", c=CVES)
def prj_graph_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    cves = rows(spark, sf_dir, CVES).where("o_orderkey % 50 = 0").withColumn("description_en", F.repeat(F.lit("word "), F.lit(8000)))
    return normalize.graph_row(cves).select("key", "published_date", "last_modified", "description", "has_exploit_ref", "is_kev")


_LABELLED = "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN array('Thing', 'CWE', 'CVE') WHEN 1 THEN array('Actor') WHEN 2 THEN array('Thing') ELSE CAST(array() AS ARRAY<STRING>) END AS labels, CASE WHEN p_partkey % 5 = 0 THEN ' ' WHEN p_partkey % 5 = 1 THEN NULL ELSE concat(' i', CAST(p_partkey AS STRING)) END AS id, p_brand AS name FROM {part}"


@query(
    "SELECT p_partkey, label, concat(label, ':', CASE WHEN p_partkey % 5 > 1 THEN concat('i', p_partkey) WHEN label = 'Actor' THEN p_brand ELSE '_anon' END) AS node FROM (SELECT p_partkey, p_brand, CASE p_partkey % 4 WHEN 0 THEN 'CVE' WHEN 1 THEN 'Actor' WHEN 2 THEN 'Thing' ELSE 'Node' END AS label FROM part)"
)
def prj_node_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, _LABELLED).select("p_partkey", T.main_label(F.col("labels")).alias("label"), T.node_id(F.col("labels"), F.col("id"), F.col("name")).alias("node"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'a' WHEN o_orderkey % 3 = 1 THEN 'b' ELSE 'a' END AS focus FROM orders")
def prj_focus_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = lambda key, label: F.struct(F.lit(key).alias("key"), F.array(label).alias("labels"))
    kind = F.col("o_orderkey") % 3
    nodes = F.array(node("a", F.when(kind == 0, "CVE").otherwise("Actor")), node("b", F.when(kind == 1, "CVE").otherwise("CWE")))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.focus(nodes)["key"].alias("focus"))


@query("SELECT w.label, w.key, (SELECT count(*) FROM $n n WHERE n.label = w.label AND n.key = w.key) AS n FROM (VALUES ('CVE', 'C10'), ('CVE', 'C99999999'), ('Actor', 'A3'), ('CWE', 'A3')) AS w(label, key)", n=NODES)
def graph_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([("CVE", "C10"), ("CVE", "C99999999"), ("Actor", "A3"), ("CWE", "A3")], "label string, key string")
    return graph.exists(rows(spark, sf_dir, NODES), wanted)


_A = "src_label = 'Actor' AND src_key IN ('A3', 'A14', 'A27')"


@query(
    f"SELECT p.start_key, count(DISTINCT trail) AS paths, count(DISTINCT CASE WHEN x.label = 'CVE' AND x.key IN (SELECT key FROM $n WHERE label = 'CVE' AND is_kev) THEN trail END) AS exploited_paths, count(DISTINCT concat(x.label, '/', x.key)) AS nodes FROM ({_paths_sql(_A, 3, 'TRUE', 'Actor', 25)}) p, unnest(string_split(p.trail, '>')) AS u(id) "
    "JOIN (SELECT edge_id, src_label AS label, src_key AS key FROM $e UNION ALL SELECT edge_id, dst_label, dst_key FROM $e) x ON x.edge_id = u.id GROUP BY 1",
    e=EDGES, n=NODES,
)
def graph_path_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = rows(spark, sf_dir, NODES), rows(spark, sf_dir, EDGES)
    return graph.path_counts(graph.attack_paths(nodes, edges, _start(spark, "Actor", "A3", "A14", "A27"), "actor", 3, 25), nodes, edges)


@query("SELECT label, key, CASE WHEN label = 'CVE' AND CAST(substr(key, 2) AS BIGINT) % 4 = 0 THEN 'seen' ELSE vuln_status END AS vuln_status, name FROM $n UNION ALL SELECT 'CVE', 'Cnew', 'seen', NULL", n=NODES)
def graph_node_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = rows(spark, sf_dir, NODES)
    batch = nodes.where("label = 'CVE' and cast(substr(key, 2) as bigint) % 4 = 0").select("label", "key").unionByName(spark.createDataFrame([("CVE", "Cnew")], "label string, key string")).withColumn("vuln_status", F.lit("seen"))
    return graph.upsert_nodes(nodes, batch).select("label", "key", "vuln_status", "name")


# -- text --

_NAMES = "SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN concat('cve-2021-', CAST(o_orderkey + 1000 AS STRING)) WHEN 1 THEN concat('CWE-', CAST(o_orderkey AS STRING)) WHEN 2 THEN ' TA0001 ' WHEN 3 THEN 'T1059.001' WHEN 4 THEN 'T12' ELSE o_clerk END AS name, CASE o_orderkey % 3 WHEN 0 THEN 'actor' WHEN 1 THEN 'software' ELSE 'made up' END AS classified FROM (SELECT o_orderkey, concat('Clerk ', CAST(o_custkey AS STRING)) AS o_clerk FROM {orders})"


@query("SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'CVE' WHEN 1 THEN 'CWE' WHEN 2 THEN 'Tactic' WHEN 3 THEN 'Technique' ELSE CASE o_orderkey % 3 WHEN 0 THEN 'Actor' WHEN 1 THEN 'Malware' ELSE 'Other' END END AS label FROM orders")
def fun_entity_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, _NAMES).select("o_orderkey", T.node_label(T.entity_type(F.col("name"), F.col("classified"))).alias("label"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN concat('FBI|', p_brand, '|CISA') WHEN p_partkey % 3 = 1 THEN 'NSA' ELSE '' END AS authors FROM part")
def prj_co_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = rows(spark, sf_dir, "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN concat('Intro\n\nCo-Authored by: FBI, ', p_brand, ' and CISA\n\nMore') WHEN 1 THEN 'This was coauthored by NSA. More' ELSE 'By NSA' END AS body FROM {part}")
    return made.select("p_partkey", F.array_join(T.co_authors(F.col("body")), "|").alias("authors"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN o_orderkey ELSE -1 END AS a FROM orders")
def fun_fenced_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = rows(spark, sf_dir, "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN concat('```json\n[{{\"a\": ', CAST(o_orderkey AS STRING), '}}]\n```') WHEN 1 THEN concat(' [{{\"a\": ', CAST(o_orderkey AS STRING), '}}, {{\"a\": 0}}]') WHEN 2 THEN '[]' ELSE 'no array' END AS t FROM {orders}")
    return made.select("o_orderkey", F.coalesce(F.get(T.json_array(F.col("t"), "array<struct<a: bigint>>"), 0)["a"], F.lit(-1)).alias("a"))


_ASKED = "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'What did the MAR say of ransomware?' WHEN 1 THEN 'Any lessons learned?' WHEN 2 THEN 'Which joint advisory?' WHEN 3 THEN 'How is it mitigated?' END AS question, CASE o_orderkey % 3 WHEN 0 THEN array('MAR', 'CSA', 'MAR', 'made up') WHEN 1 THEN array('made up') END AS chosen FROM {orders}"


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'MAR,STOPRANSOMWARE' WHEN 1 THEN 'IR_LESSONS' WHEN 2 THEN 'JOINT_CSA' ELSE '' END AS by_words, CASE o_orderkey % 3 WHEN 0 THEN 'CSA,MAR' ELSE '' END AS by_choice FROM orders")
def txt_wanted_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, _ASKED).select("o_orderkey", F.array_join(T.wanted_types(F.col("question")), ",").alias("by_words"), F.array_join(T.wanted_types(F.col("question"), F.col("chosen")), ",").alias("by_choice"))


_SCOPE = "SELECT DISTINCT label FROM (SELECT label FROM {embeddings} WHERE vec_id % 37 = 0) ORDER BY label LIMIT 20"


@query(
    f"WITH {_BM25}, scope AS ({_SCOPE.replace('{embeddings}', 'embeddings')}), {_near_sql(40, 50, 'label IN (SELECT label FROM scope)')}, fused AS (SELECT coalesce(l.query_id, n.query_id) AS query_id, coalesce(l.id, n.id) AS id, n.rank AS vec_rank, coalesce(0.6 / (60 + l.rank), 0) + coalesce(0.4 / (60 + n.rank), 0) AS rrf FROM lex l FULL OUTER JOIN near n ON l.query_id = n.query_id AND l.id = n.id), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, id) AS fused_rank FROM fused) SELECT query_id, id, round(rrf, 9) AS rrf_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_rank) AS r FROM ranked WHERE query_id < 40 AND (vec_rank IS NOT NULL OR (fused_rank <= 30 AND id IN (SELECT vec_id FROM embeddings WHERE label IN (SELECT label FROM scope))))) WHERE r <= 10".replace("$", "$$")
)
def txt_scoped_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, pool = _vectors(spark, sf_dir, 40)
    scope = answer.mentioned_advisories(pool.where("vec_id % 37 = 0").select(F.col("label").alias("advisory_id")))
    questions = table(spark, sf_dir, "benchmark").where("item_id < 40").select(F.col("item_id").alias("query_id"), "text").join(asked, "query_id")
    chunks = pool.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("advisory_id"))
    vectors = pool.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return answer.scoped_search(_index(spark, sf_dir), questions, chunks, scope, vectors).select("query_id", "id", F.round("rrf_score", 9).alias("rrf_score"))


# -- evaluation --


@query("SELECT count(*) AS n, round(avg(CASE WHEN (o_orderkey % 3 = 0) = (o_orderkey % 2 = 0) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM orders")
def evl_pair_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.pair_accuracy(table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 3 == 0).alias("same"), (F.col("o_orderkey") % 2 == 0).alias("predicted")))


@query("SELECT ordinal FROM $t WHERE ordinal % 3 = 0 AND ordinal % 5 <> 0", t=TRIPLETS)
def val_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("ordinal")
    return triplets.verified(rows(spark, sf_dir, TRIPLETS).withColumns({"first": F.when(n % 3 == 0, True).when(n % 3 == 1, False), "second": n % 5 != 0}), "first", "second").select("ordinal")


# -- questions and briefs --

_QUESTIONS = ("Which actors use T1059?", "How do I mitigate this?", "Explain how A1 exploits CVE-2021-1000", "Hello there", "What is linked to A3?")


@query("SELECT * FROM (VALUES (0, 'graph', 'uses'), (1, 'text', ''), (2, 'both', 'exploits'), (3, 'both', ''), (4, 'graph', '')) AS t(n, route, pattern)")
def orc_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n, answer.route(q).route, answer.pattern(q) or "") for n, q in enumerate(_QUESTIONS)], "n int, route string, pattern string")


@query("SELECT * FROM (VALUES (1, 'both'), (2, 'both'), (3, 'text')) AS t(n, route)")
def orc_route_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A classifier that fails, one that says nonsense, one that answers."""

    def fails(_: str) -> str:
        raise TimeoutError

    return spark.createDataFrame([(n, answer.route("x", c).route) for n, c in ((1, fails), (2, lambda _: "maybe"), (3, lambda _: "text"))], "n int, route string")


@query("SELECT 'graph' AS route, src_key, rel, dst_key FROM (SELECT DISTINCT src_key, rel, dst_key FROM $e WHERE rel = 'USES' ORDER BY 1, 2, 3 LIMIT 50) UNION ALL SELECT 'text', 'what is targeted?', NULL, NULL", e=EDGES)
def orc_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question that the graph answers, and one that falls back to text."""
    nodes, edges = rows(spark, sf_dir, NODES), rows(spark, sf_dir, EDGES)
    find = lambda q: spark.createDataFrame([(q, None, None)], "src_key string, rel string, dst_key string")
    out = None
    for question in ("which actors use it?", "what is targeted?"):
        found = answer.answer(question, nodes, edges, find, force="graph")
        rows_ = found["graph"] if found["graph"] is not None else found["text"]
        part = rows_.select(F.lit(found["route"]).alias("route"), "src_key", "rel", "dst_key")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT 'uses' AS name, 3 AS calls UNION ALL SELECT NULL, 3")
def orc_pattern_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chooser that gets it right at its third attempt, and one that never does."""

    def attempt(names: list[str]) -> tuple[str | None, int]:
        seen: list = []

        def ask(_: str, error: str | None) -> str:
            seen.append(error)
            return names[len(seen) - 1]

        return answer.pattern("q", ask), len(seen)

    return spark.createDataFrame([attempt(["a", "b", "uses"]), attempt(["a", "b", "c", "uses"])], "name string, calls int")


_NEW = "is_kev AND kev_date_added >= DATE '{0}' AND kev_date_added < DATE '{1}'".format(START, END)
_ORDER = "kev_date_added DESC NULLS LAST, cvss_score DESC NULLS LAST, exploitability_score DESC NULLS LAST, impact_score DESC NULLS LAST"
_BRIEF = f"""top AS (SELECT cve_id, tier FROM (SELECT *, {_TIER} AS tier FROM $c WHERE {_WINDOW}) WHERE tier <= 4 ORDER BY tier, {_ORDER}, last_modified DESC NULLS LAST, cve_id LIMIT 10),
new AS (SELECT cve_id, 2 AS tier FROM $c WHERE vuln_status <> 'REJECTED' AND {_NEW} ORDER BY kev_date_added DESC, CASE WHEN kev_ransomware_use = 'Known' THEN 0 ELSE 1 END, cvss_score DESC NULLS LAST, exploitability_score DESC NULLS LAST, impact_score DESC NULLS LAST, cve_id LIMIT 5),
items AS (SELECT * FROM top UNION ALL SELECT * FROM new WHERE cve_id NOT IN (SELECT cve_id FROM top))"""


@query(f"WITH {_BRIEF} SELECT cve_id, tier, concat(cve_id, ' (tier ', tier, ': ', {_REASON}, ')', chr(10), CASE WHEN right(cve_id, 1) IN ('0', '4', '8') THEN '- no passages' ELSE concat('- first of ', cve_id, chr(10), '- second of ', cve_id) END) AS block FROM items", c=CVES)
def orc_weekly_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brief's blocks; three passages are found for most, of which the best two are kept."""

    def find(asked: DataFrame) -> DataFrame:
        some = asked.where(~F.right("cve_id", F.lit(1)).isin("0", "4", "8"))
        return some.select("cve_id", F.posexplode(F.array(*[F.concat(F.lit(f"{x} of "), F.col("cve_id")) for x in ("first", "second", "third")])).alias("rank", "chunk_text")).withColumn("rank", F.col("rank") + 1)

    return answer.weekly_brief(rows(spark, sf_dir, CVES), START, END, find, most=2)[0]


@query(f"WITH {_BRIEF} SELECT cve_id, concat('How is ', cve_id, ' exploited, what does it affect, and how is it mitigated? (tier ', tier, ')') AS question FROM items", c=CVES)
def orc_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cves = rows(spark, sf_dir, CVES)
    return answer.questions(digest.brief_items(digest.top(cves, START, END), digest.newly_added(cves, START, END)))


@query("SELECT * FROM (VALUES (0, 'meta', '2'), (1, 'cves', 'a,b'), (2, 'markdown', 'one '), (3, 'markdown', 'two '), (4, 'markdown', 'x'), (5, 'done', '')) AS t(n, event, data)")
def str_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = lambda d: d if isinstance(d, str) else ",".join(d) if isinstance(d, list) else str(d.get("count", ""))
    return spark.createDataFrame([(n, e, said(d)) for n, (e, d) in enumerate(answer.events(["a", "b"], "one two x", 4))], "n int, event string, data string")


@query(
    f"SELECT a.advisory_id, CASE WHEN advisory_type = 'analysis_report' THEN 'ANALYSIS_REPORT' ELSE 'CSA' END AS document_type, concat('CVE-2021-', 10000 + p_partkey) AS cve_ids, CAST(3 AS BIGINT) AS chunks, CAST(length('Lead ') + length(p_brand) + length({_BODY}) + length('Patch ') + length(p_type) AS DOUBLE) AS embedded, CAST(1 AS BIGINT) AS indexed "
    f"FROM ({_LISTED_ADVISORIES}) a JOIN (SELECT p_partkey AS k, p_brand, p_type, p_name FROM part) p ON a.p_partkey = p.k WHERE published_date >= DATE '2024-04-01' AND NOT ({_KNOWN_ADVISORY})"
)
def orc_advisory_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List pages to index: type, identifiers, chunks and vectors of each new advisory, and whether its text is found by its number."""
    known = rows(spark, sf_dir, f"SELECT {_ADVISORY} AS advisory_id FROM {{part}} WHERE {_KNOWN_ADVISORY}")
    path = _folder(spark)
    made = answer.advisory_pipeline(_list_pages(spark, sf_dir), rows_dealt(spark, sf_dir, _PAGES).select("advisory_id", "html"), known, path, site=SITE, embed=_embed, since=dt.date(2024, 4, 1))
    per = made["chunks"].groupBy("advisory_id").agg(F.count("*").alias("chunks"), F.sum(F.get("chunk_embedding", F.lit(0)).cast("double")).alias("embedded"))
    hits = search.Index.read(spark, path).postings.where("term like 'cve-2021-%'").select(F.regexp_replace("id", "_[0-9]+$", "").alias("advisory_id"), F.col("tf").alias("indexed"))
    return made["advisories"].join(per, "advisory_id").join(hits, "advisory_id").select("advisory_id", "document_type", F.array_join("cve_ids_mentioned", ",").alias("cve_ids"), "chunks", "embedded", "indexed")


# -- usage --

_CALLS = "SELECT concat('c', CAST(event_id AS STRING)) AS log_id, event_type AS stage, CASE WHEN event_id % 3 = 0 THEN 'small' ELSE 'unpriced' END AS model, CAST(event_id % 1000 AS BIGINT) AS input_tokens, CAST(event_id % 100 AS BIGINT) AS output_tokens FROM {events}"


@query("SELECT log_id, model, CASE WHEN model = 'small' THEN CAST(round((input_tokens * 2.0 + output_tokens * 8.0) / 1000000, 6) AS DOUBLE) END AS estimated_cost_usd FROM $c", c=_CALLS)
def snk_usage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls appended to a log in two batches that overlap."""
    calls, spec = rows(spark, sf_dir, _CALLS), schemas.TABLES["llm_usage_log"]
    prices = spark.createDataFrame([("small", 2.0, 8.0)], "model string, input_price double, output_price double")
    log = schemas.conform(calls.limit(0), spec)
    for part in (calls.where("cast(substr(log_id, 2) as bigint) % 4 < 3"), calls.where("cast(substr(log_id, 2) as bigint) % 4 > 1")):
        log = digest.log_usage(log, schemas.conform(part, spec).drop("estimated_cost_usd"), prices)
    return log.select("log_id", "model", F.col("estimated_cost_usd").cast("double").alias("estimated_cost_usd"))


@query("SELECT user_id AS run_id, CAST(count(*) + max(CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS calls, CAST(sum(event_id % 1000) + max(CASE WHEN user_id % 2 = 0 THEN 500 ELSE 0 END) AS BIGINT) AS input_tokens, CAST(sum(event_id % 100) + 7 AS BIGINT) AS output_tokens, round(sum(value) + 0.5, 4) AS cost_usd FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def agg_run_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("user_id is not null")
    evidence = e.select(F.col("user_id").alias("run_id"), F.lit(1).alias("calls"), (F.col("event_id") % 1000).alias("input_tokens"), (F.col("event_id") % 100).alias("output_tokens"), F.col("value").alias("cost_usd"))
    synthesis = e.select(F.col("user_id").alias("run_id")).distinct().select("run_id", F.when(F.col("run_id") % 2 == 0, 500).otherwise(0).alias("input_tokens"), F.lit(7).alias("output_tokens"), F.lit(0.5).alias("cost_usd"))
    return digest.run_usage(evidence, synthesis).withColumn("cost_usd", F.round("cost_usd", 4))
