import datetime as dt
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lynceus.functions import text as T
from lynceus.operators import digest, evaluate, filters, graph, merge, search, sections, triplets
from lynceus.plans import answer
from lynceus.streaming import incremental

# -- merge --


@pytest.fixture
def target(spark):
    return spark.createDataFrame([(1, "a", True), (2, "b", None), (3, None, False)], "k int, v string, kev boolean")


def _set(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_upsert_twice_is_upsert_once(spark, target):
    batch = spark.createDataFrame([(2, "B"), (4, "D"), (4, "E")], "k int, v string")
    once = merge.upsert(target, batch, ["k"], order=["v"])
    assert _set(once.select("k", "v").na.fill("")) == [(1, "a"), (2, "B"), (3, ""), (4, "E")]
    assert _set(merge.upsert(once, batch, ["k"], order=["v"]).na.fill("")) == _set(once.na.fill(""))
    assert {r.k: r.kev for r in once.collect()} == {1: True, 2: None, 3: False, 4: None}


def test_null_keys_are_keys(spark):
    old = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    batch = spark.createDataFrame([(None, "B"), (2, "c"), (None, "A")], "k int, v string")
    for how in (merge.upsert, merge.insert_only):
        once = how(old, batch, ["k"])
        assert _set(how(once, batch, ["k"]).na.fill(-1).na.fill("")) == _set(once.na.fill(-1).na.fill(""))
    assert {r.v for r in merge.upsert(old, batch, ["k"]).where("k is null").collect()} == {"B"}
    assert merge.delete_where_in(old, batch, ["k"]).count() == 1
    assert tuple(merge.matched_counts(batch, old, ["k"]).first()) == (1, 1)


def test_rows_of_one_key_are_told_apart_without_an_order(spark):
    rows = [(1, "a", [1]), (1, "b", [2]), (1, None, [3]), (2, "x", None)]
    frame = spark.createDataFrame(rows, "k int, v string, w array<int>").withColumn("m", F.create_map(F.lit("a"), F.col("k")))
    for part in (1, 4):
        assert sorted((r.k, r.v) for r in merge.last_by_key(frame.repartition(part), ["k"]).collect()) == [(1, "b"), (2, "x")]


def test_upsert_of_newer_rows_only(spark):
    old = spark.createDataFrame([(1, 5, "x"), (2, 5, "y")], "k int, at int, v string")
    new = spark.createDataFrame([(1, 4, "stale"), (2, 6, "fresh"), (3, 1, "first")], "k int, at int, v string")
    assert _set(merge.upsert(old, new, ["k"], newest_only="at")) == [(1, 5, "x"), (2, 6, "fresh"), (3, 1, "first")]


def test_update_insert_and_replace(spark, target):
    batch = spark.createDataFrame([(3, "C"), (9, "Z")], "k int, v string")
    assert [r.k for r in merge.update_only(target, batch, ["k"]).orderBy("k").collect()] == [1, 2, 3]
    assert [r.v for r in merge.insert_only(target, batch, ["k"]).orderBy("k").collect()] == ["a", "b", None, "Z"]
    children = spark.createDataFrame([("p", 1, 0.5), ("p", 2, 0.6), ("q", 1, 0.7)], "parent string, n int, vector double")
    fresh = spark.createDataFrame([("p", 7)], "parent string, n int")
    assert sorted(tuple(r) for r in merge.replace_children(children, fresh, ["parent"]).na.fill(-1).collect()) == [("p", 7, -1.0), ("q", 1, 0.7)]


def test_queue_is_filled_and_drained(spark, target):
    queue = spark.createDataFrame([(7, True, "old"), (8, False, "keep")], "k int, fetched boolean, note string")
    batch = spark.createDataFrame([(1, "known"), (7, None), (9, "new")], "k int, note string")
    filled = merge.enqueue(queue, batch, target, ["k"], values=["note"])
    assert sorted(tuple(r) for r in filled.collect()) == [(7, False, "old"), (8, False, "keep"), (9, False, "new")]
    arrivals = spark.createDataFrame([(9, "text", None)], "k int, v string, kev boolean")
    grown, closed = merge.drain(filled, arrivals, target, ["k"], overlay=["note"])
    assert grown.where("k = 9").count() == 1 and {r.k: r.fetched for r in closed.collect()} == {7: False, 8: False, 9: True}


# -- text and sections --


def test_tokens(spark):
    text = "The CVE-2024-1234 and cwe-79; T1059.001 on 10.0.0.1, see aa23-215a: Naïve exploit!"
    frame = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    rows = [r[0] for r in frame.select(T.tokens(F.col("t"))).collect()]
    assert rows == [["cve-2024-1234", "cwe-79", "t1059.001", "aa23-215a", "10.0.0.1", "see", "na", "ve", "exploit"], [], []]


@settings(max_examples=25, deadline=None)
@given(n=st.integers(0, 60), most=st.integers(2, 20), overlap=st.integers(0, 19))
def test_windows_cover_the_tokens(spark, n, most, overlap):
    if overlap >= most:
        with pytest.raises(ValueError):
            T.windows(F.array(), most, overlap)
        return
    words = [str(i) for i in range(n)]
    found = spark.range(1).select(T.windows(F.lit(words) if words else F.array().cast("array<string>"), most, overlap)).first()[0]
    parts = [w.tokens for w in found]
    assert parts[0] + [x for p in parts[1:] for x in p[overlap:]] == words
    assert all(len(p) <= most for p in parts) and len(parts) == (1 if n <= most else math.ceil((n - overlap) / (most - overlap)))


PAGE = """<!doctype html><html><body><nav>menu</nav><main><!-- hidden --><p>Opening words.<p>More.
<h2>Technical Details</h2><p>Attack by T1059 and CVE-2024-1111.</p><h3>Version History</h3><p>kept text</p><h3>Initial Access</h3><p>how they came</p>
<h2>Disclaimer</h2><p>dropped</p><h2>Mitigations</h2><p>patch &amp; pray</p><script>no()</script></main></body></html>"""


def test_sections():
    assert sections.sections(PAGE) == [
        ("Summary", None, "Opening words. More."),
        ("Technical Detail", None, "Attack by T1059 and CVE-2024-1111. kept text"),
        ("Technical Detail", "Initial Access", "how they came"),
        ("Mitigation", None, "patch & pray"),
    ]
    assert sections.flat_sections(PAGE)[0] == ("General", "Opening words. More.")
    assert sections.sections("<h3>Findings of x</h3><h4>Y</h4>text", "MAR") == [("Findings", "Y", "text")]
    assert sections.sections(None) == [] and sections.sections("") == []


def test_chunks(spark):
    long_page = "<h3>Indicators</h3><p>" + "x " * 2600 + "</p><h3>Other</h3><p>" + "word " * 2000 + "</p>"
    pages = spark.createDataFrame([("aa24-001a", PAGE, "CSA"), ("aa24-002a", long_page, None), ("aa24-003a", None, "CSA")], "advisory_id string, html string, document_type string")
    rows = sections.chunks(pages).orderBy("chunk_id").collect()
    first = [r for r in rows if r.advisory_id == "aa24-001a"]
    assert [r.chunk_id for r in first] == [f"aa24-001a_{k:03d}" for k in range(4)]
    assert first[1].cve_ids == ["CVE-2024-1111"] and first[1].mitre_tech_ids == ["T1059"] and first[0].content_hash != first[1].content_hash
    assert [(r.section_name, r.token_count) for r in rows if r.advisory_id == "aa24-002a"] == [("IoC", 2500), ("IoC", 250), ("General", 1000), ("General", 1000), ("General", 300)]
    assert sections.chunks(pages).select("chunk_id", "content_hash").exceptAll(sections.chunks(pages).select("chunk_id", "content_hash")).count() == 0


def test_document_types(spark):
    rows = [("MAR-1 x", "analysis_report", None), ("other", "analysis_report", None), ("#StopRansomware: y", "cybersecurity_advisory", None), ("CISA red team's operations", "cybersecurity_advisory", None), ("z", "cybersecurity_advisory", ["a", "b"]), ("z", "cybersecurity_advisory", None)]
    frame = spark.createDataFrame(rows, "title string, kind string, co array<string>")
    found = [r[0] for r in frame.select(T.document_type(F.col("title"), F.col("kind"), F.col("co"), F.lit("the FBI and NSA"))).collect()]
    assert found == ["MAR", "ANALYSIS_REPORT", "STOPRANSOMWARE", "IR_LESSONS", "JOINT_CSA", "JOINT_CSA"]
    body = spark.createDataFrame([("Intro\nCo-Authored by: FBI, NSA and CISA\n\nMore",)], "b string")
    assert body.select(T.co_authors(F.col("b"))).first()[0] == ["FBI", "NSA", "CISA"]
    adv = spark.createDataFrame([("a", "t", "cybersecurity_advisory", None, None), ("b", "t", "x", None, "MAR")], "advisory_id string, title string, advisory_type string, co_authors array<string>, document_type string")
    pages = spark.createDataFrame([("a", "<p>By the FBI</p><p>and NSA.</p>")], "advisory_id string, html string")
    assert {r.advisory_id: r.document_type for r in sections.classified(adv, pages).collect()} == {"a": "JOINT_CSA", "b": "MAR"}


def test_small_expressions(spark):
    frame = spark.createDataFrame([('```json\n[{"a": 1}]\n```',), ("nonsense",)], "t string")
    assert [r[0] for r in frame.select(T.json_array(F.col("t"), "array<struct<a: int>>")).collect()] == [[(1,)], None]
    names = spark.createDataFrame([("CVE-2024-0001", "actor"), ("ta0001", None), ("T1059", None), ("x", "software"), ("x", "made up")], "n string, c string")
    assert [r[0] for r in names.select(T.node_label(T.entity_type(F.col("n"), F.col("c")))).collect()] == ["CVE", "Tactic", "Technique", "Malware", "Other"]


# -- search --


def test_bm25_by_hand(spark, tmp_path):
    docs = spark.createDataFrame([(1, "apple banana apple"), (2, "banana cherry"), (3, "date"), (4, "")], "id int, text string")
    index = search.build(docs, "id", "text")
    index.write(str(tmp_path / "index"))
    index = search.Index.read(spark, str(tmp_path / "index"))
    asked = spark.createDataFrame([(9, "Apple apple banana")], "query_id int, text string")
    found = {r.id: r.score for r in search.bm25(index, asked).collect()}
    n, avg = 4, 6 / 4
    idf = lambda df: math.log(n - df + 0.5) - math.log(df + 0.5)
    raw = {"apple": idf(1), "banana": idf(2), "cherry": idf(1), "date": idf(1)}
    weight = lambda t: raw[t] if raw[t] >= 0 else 0.25 * sum(raw.values()) / 4
    part = lambda tf, dl: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    assert found == pytest.approx({1: 2 * weight("apple") * part(2, 3) + weight("banana") * part(1, 3), **({2: weight("banana") * part(1, 2)} if weight("banana") > 0 else {})})


def _ranked(spark, *ids):
    return spark.createDataFrame([(1, i, 1.0 / (k + 1), k + 1) for k, i in enumerate(ids)], "query_id int, id int, score double, rank int")


def test_fusion_at_its_ends(spark):
    lexical, vector = _ranked(spark, 1, 2, 3), _ranked(spark, 3, 4)
    order = lambda a: [r.id for r in search.fuse(lexical, vector, alpha=a).orderBy("fused_rank").collect()]
    assert order(0.0) == [1, 2, 3, 4] and order(1.0)[:2] == [3, 4] and sorted(order(1.0)[2:]) == [1, 2]
    a, b = search.fuse(lexical, vector, alpha=0.3), search.fuse(vector, lexical, alpha=0.7)
    assert {r.id: round(r.rrf_score, 12) for r in a.collect()} == {r.id: round(r.rrf_score, 12) for r in b.collect()}


def test_hybrid_looks_up_lexical_hits_near_the_top_only(spark):
    lexical, vector = _ranked(spark, *range(100, 150)), _ranked(spark, 1)
    allowed = spark.createDataFrame([(i,) for i in (1, 101, 140)], "id int")
    assert [r.id for r in search.hybrid(lexical, vector, allowed, top_k=3).orderBy("rank").collect()] == [101, 1]


def test_nearest_in_blocks(spark):
    rows = [(k, [float(k % 7), float(k % 5), 1.0]) for k in range(60)]
    pool = spark.createDataFrame(rows, "id int, v array<float>")
    asked = pool.select(F.col("id").alias("query_id"), F.col("v").alias("vector")).where("id < 9")
    one = _set(search.nearest(asked, pool, 5, id_col="id", vector_col="v", exclude_self=True).select("query_id", "id", "rank"))
    many = _set(search.nearest(asked, pool, 5, id_col="id", vector_col="v", exclude_self=True, per_pass=4).select("query_id", "id", "rank"))
    assert one == many and all(q != i for q, i, _ in one)
    assert _set(search.similar_pairs(pool, 0.99, id_col="id", vector_col="v").select("a", "b")) == _set(search.similar_pairs(pool, 0.99, id_col="id", vector_col="v", block=8).select("a", "b"))
    with pytest.raises(Exception, match="a vector must have 4 numbers"):
        search.check_dimension(pool, "v", 4).collect()


def test_missing_vectors_are_filled(spark):
    chunks = spark.createDataFrame([("a", "some text", None), ("b", "other", [1.0] * 8)], "chunk_id string, chunk_text string, chunk_embedding array<float>")
    found = {r.chunk_id: r.chunk_embedding for r in search.missing_vectors(chunks, search.hashed_embedding(8)).collect()}
    assert found["b"] == [1.0] * 8 and len(found["a"]) == 8 and sum(x * x for x in found["a"]) == pytest.approx(1.0)


def test_filters(spark):
    chunks = spark.createDataFrame([("c1", "a1", "CVE", ["CVE-1", None]), ("c2", "a2", "IoC", [None]), ("c3", "a1", "IoC", None)], "chunk_id string, advisory_id string, section_name string, cve_ids array<string>")
    parents = spark.createDataFrame([("a1", "CSA"), ("a2", "MAR")], "advisory_id string, document_type string")
    ids = lambda **k: sorted(r.chunk_id for r in filters.metadata(chunks, parents, **k).collect())
    assert ids() == ["c1", "c2", "c3"] and ids(document_types=["MAR"]) == ["c2"] and ids(section_names=["IoC"], ids=["a1"]) == ["c3"] and ids(arrays={"cve_ids": ["CVE-1"]}) == ["c1"]


# -- graph --


@pytest.fixture
def small(spark):
    nodes = spark.createDataFrame(
        [("CVE", "c1", None, "2020-01-01"), ("CVE", "c2", "Deferred", None), ("CVE", "c3", None, "2010-01-01"), ("CWE", "w1", None, None), ("Technique", "t1", None, None), ("Technique", "t2", None, None), ("Actor", "a1", None, None)],
        "label string, key string, vuln_status string, published_date string",
    )
    edges = graph.keyed(
        spark.createDataFrame(
            [("CVE", "c1", "HAS_WEAKNESS", "CWE", "w1", "x"), ("CVE", "c1", "REFERENCES_TECHNIQUE", "Technique", "t1", "x"), ("CVE", "c1", "REFERENCES_TECHNIQUE", "Technique", "t2", "x"), ("CVE", "c2", "REFERENCES_TECHNIQUE", "Technique", "t1", "x"), ("Actor", "a1", "EXPLOITS", "CVE", "c1", "x"), ("CVE", "c1", "LEADS", "CVE", "c3", "x"), ("CVE", "c3", "LEADS", "CVE", "c1", "x")],
            "src_label string, src_key string, rel string, dst_label string, dst_key string, advisory_id string",
        )
    )
    return nodes, edges


def test_paths(spark, small):
    nodes, edges = small
    start = lambda label, key: spark.createDataFrame([(label, key)], "label string, key string")
    assert sorted(r.end_key for r in graph.attack_paths(nodes, edges, start("CVE", "c1"), "cve", 4).collect()) == ["t1", "t2", "w1"]
    assert graph.attack_paths(nodes, edges, start("CVE", "c2"), "cve").count() == 0
    trails = graph.paths(start("CVE", "c1"), edges, 8).collect()
    assert max(r.hops for r in trails) == 3 and all(len(set(r.edge_ids)) == len(r.edge_ids) for r in trails)
    assert sorted(r.end_key for r in graph.attack_paths(nodes, edges, start("Actor", "a1"), "actor", 2).collect()) == ["c1", "c3", "t1", "t2", "w1"]
    hop = lambda h, n=10: sorted(r.end_key for r in graph.technique_paths(nodes, edges, start("Technique", "t1"), h, n).collect())
    assert hop(1) == ["c1"] and hop(2) == ["c1", "w1"] and hop(3) == ["c1", "t2", "w1"] and hop(3, 3) == ["c1", "w1"]
    assert graph.clamp(99, 0) == (8, 1)
    with pytest.raises(ValueError):
        graph.attack_paths(nodes, edges, start("CWE", "w1"), "cwe")


def test_components_part_the_nodes(spark):
    edges = spark.createDataFrame([("x", "a", "b"), ("x", "b", "c"), ("x", "d", "e"), ("y", "a", "d")], "advisory_id string, src_key string, dst_key string")
    assert _set(graph.components(edges)) == [("x", "a", "a"), ("x", "b", "a"), ("x", "c", "a"), ("x", "d", "d"), ("x", "e", "d"), ("y", "a", "a"), ("y", "d", "a")]
    assert {(r.scope, r.central) for r in graph.central_nodes(edges).collect()} == {("x", "b"), ("x", "d"), ("y", "a")}
    assert [tuple(r) for r in graph.inference_candidates(edges).collect()] == [("x", "b", "d")]


def test_large_scopes_are_labelled_in_rounds(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(90)] + [("c", f"p{k:02d}", f"p{k + 1:02d}") for k in range(40)] + [("d", "x", "x")]
    edges = spark.createDataFrame(rows, "advisory_id string, src_key string, dst_key string")
    found = [sorted(map(str, graph.components(edges, limit).collect())) for limit in (10**6, 20, 0)]
    assert found[0] == found[1] == found[2] and len(found[0]) > 100


def test_graph_counts_and_node_upserts(spark, small):
    nodes, edges = small
    asked = nodes.select("label", "key").limit(1).unionByName(spark.createDataFrame([("CVE", "nowhere")], "label string, key string"))
    assert {r.key: r.n for r in graph.exists(nodes, asked).collect()}["nowhere"] == 0
    once = graph.upsert_nodes(nodes, asked)
    assert graph.upsert_nodes(once, asked).count() == once.count() == nodes.count() + 1


def test_tables_by_their_specifications(spark):
    from lynceus import schemas

    one = spark.createDataFrame([("M1", "a", None), ("M1", "b", "x"), (None, "c", "y")], "mitigation_id string, name string, extra string")
    tables = merge.upsert_tables({}, {"attack_mitigations": one}, schemas.TABLES)
    assert [(r.mitigation_id, r.name) for r in tables["attack_mitigations"].collect()] == [("M1", "b")] and tables["attack_mitigations"].columns == schemas.TABLES["attack_mitigations"].names
    two = merge.upsert_tables(tables, {"attack_mitigations": spark.createDataFrame([("M1", "z"), ("M2", "n")], "mitigation_id string, name string")}, schemas.TABLES)
    assert sorted((r.mitigation_id, r.name) for r in two["attack_mitigations"].collect()) == [("M1", "z"), ("M2", "n")]


def test_edges_need_both_ends(spark, small):
    nodes, edges = small
    new = spark.createDataFrame([("Actor", "a1", "USES", "Technique", "t2", "z"), ("Actor", "a1", "USES", "Technique", "t2", "z"), ("Actor", "a1", "EXPLOITS", "CVE", "nope", "z")], edges.drop("edge_id").schema)
    grown, counts = graph.upsert_edges(nodes, edges, new)
    assert tuple(counts.first()) == (2, 1) and grown.count() == edges.count() + 1
    assert graph.upsert_edges(nodes, grown, new)[0].count() == grown.count()


def test_pairs_of_mentioned_ids(spark):
    rows = spark.createDataFrame([(["CVE-2024-2", None], ["t1059", "X123", "T1566.001"]), (None, ["T1"])], "cve_ids array<string>, mitre_tech_ids array<string>")
    assert _set(graph.cooccurrences(rows)) == [("CVE-2024-2", "T1059"), ("CVE-2024-2", "T1566.001")]


def test_technique_numbers_may_have_more_than_four_digits(spark):
    rows = spark.createDataFrame([(["CVE-2024-2"], ["t10001", "T106000.002", "T999"])], "cve_ids array<string>, mitre_tech_ids array<string>")
    assert _set(graph.cooccurrences(rows)) == [("CVE-2024-2", "T10001"), ("CVE-2024-2", "T106000.002")]


# -- triplets and evaluation --


def test_triplet_validation(spark):
    good = [("APT1", r, "thing") for r in filters.RELATIONS]
    bad = [("APT1", r, "thing") for r in ("", "USES", "Uses", "kills", None)] + [("The attacker", "uses", "x"), ("a", "uses", " malware "), ("", "uses", "x"), ("x", "uses", None)]
    ok, rejected = triplets.validate(spark.createDataFrame(good + bad, "subject string, relation string, object string"))
    assert ok.count() == 7 and rejected.count() == len(bad) and rejected.where("reason is null").count() == 0


def test_triplets_are_deduplicated_by_case(spark):
    rows = spark.createDataFrame([(1, "A", "uses", "B"), (2, "a", "uses", "b"), (3, "a", "USES", "b")], "ordinal int, subject string, relation string, object string")
    once = triplets.first_of_each(rows)
    assert _set(once.select("ordinal")) == [(1,), (3,)] and _set(triplets.first_of_each(once)) == _set(once)


def test_extraction_matching(spark):
    gold = spark.createDataFrame([("d", 1, "Group", "uses", "papercut MF/NG"), ("d", 2, "Group", "exploits", "CVE-2024-1"), ("d", 3, "Other", "targets", "banks")], "advisory_id string, ordinal int, subject string, relation string, object string")
    found = spark.createDataFrame([("d", 1, "group", "uses", "PaperCut NG"), ("d", 2, "the group", "uses", "CVE-2024-1"), ("d", 3, "x", "uses", "y"), ("d", 4, "group", "uses", "papercut ng")], gold.schema)
    row = evaluate.extraction(gold, found).first()
    assert (row.matched, row.gold, row.predicted) == (2, 3, 4) and row.precision == 0.5 and row.recall == pytest.approx(2 / 3)


def test_running_sum_keeps_the_row_that_reaches_the_target(spark):
    rows = spark.createDataFrame([(k, 4) for k in range(10)], "k int, n int")
    assert [r.k for r in evaluate.running_until(rows, "n", 10, "k").orderBy("k").collect()] == [0, 1, 2]


def test_retrieval_metrics(spark):
    golden = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "query_id int, expected int")
    ranked = spark.createDataFrame([(1, 10, 1), (2, 20, 4), (2, 20, 9), (3, 1, 1)], "query_id int, id int, rank int")
    row = evaluate.retrieval_summary(evaluate.retrieval(golden, ranked)).first()
    assert (row.queries, row.hit_1, row.hit_5) == (3, pytest.approx(1 / 3, abs=1e-6), pytest.approx(2 / 3, abs=1e-6))
    assert row.mrr == pytest.approx((1 + 0.25) / 3, abs=1e-6) and row.ndcg_10 == pytest.approx((1 + 1 / math.log2(5)) / 3, abs=1e-6)


# -- digest and incremental --


def test_digest_windows():
    today = dt.date(2024, 3, 10)
    assert digest.window_dates(today) == (dt.date(2024, 3, 3), today)
    with pytest.raises(ValueError):
        digest.window_dates(today, start=today)


def test_status_case(spark):
    rows = spark.createDataFrame([("REJECTED",), ("Rejected",), (None,), ("Analyzed",)], "vuln_status string")
    assert rows.where(filters.not_rejected()).count() == 2 and rows.where(filters.not_rejected(any_case=True)).count() == 1


@settings(max_examples=60, deadline=None)
@given(start=st.dates(dt.date(2000, 1, 1), dt.date(2030, 1, 1)), length=st.integers(-5, 90), days=st.integers(1, 30))
def test_slices_tile_the_window(start, length, days):
    end = start + dt.timedelta(days=length)
    found = incremental.slices(start, end, days)
    covered = [a + dt.timedelta(days=k) for a, b in found for k in range((b - a).days + 1)]
    assert covered == [start + dt.timedelta(days=k) for k in range(length + 1)]
    assert all((b - a).days < days for a, b in found)


def test_window_resolution():
    d = dt.date
    assert incremental.resolve_window(d(2024, 7, 1), d(2024, 6, 15)) == (d(2024, 6, 16), d(2024, 7, 1))
    assert incremental.resolve_window(d(2024, 7, 1), d(2024, 6, 15), forced_start=d(2024, 2, 1), forced_end=d(2024, 2, 5)) == (d(2024, 2, 1), d(2024, 2, 5))
    assert incremental.resolve_window(d(2024, 7, 1), d(2024, 7, 1)) == (d(2024, 7, 2), d(2024, 7, 2))
    assert incremental.resolve_window(d(2024, 7, 1), newest=d(2024, 1, 1))[0] == d(2024, 1, 1) and incremental.resolve_window(d(2024, 7, 1))[0] == d(2000, 1, 1)
    assert len(incremental.slices(d(2024, 1, 1), d(2024, 1, 20))) == 3


def test_stream_loads_each_file_once(spark, tmp_path):
    from lynceus.sources import tables

    source, target = tmp_path / "in", str(tmp_path / "t")
    source.mkdir()
    schema = "k INT, v STRING"
    empty = spark.createDataFrame([], schema)
    seen = []
    load = lambda: incremental.load_stream(spark, str(source), empty.schema, target, empty, ["k"], str(tmp_path / "c"), order=["v"], counters=seen.append)
    (source / "1.json").write_text('{"k": 1, "v": "a"}\n{"k": 2, "v": "b"}')
    load()
    version = tables._numbers(spark, target)
    load()
    assert tables._numbers(spark, target) == version
    (source / "2.json").write_text('{"k": 2, "v": "B"}\n{"k": 3, "v": "c"}\n{"k": 3, "v": "b"}\n{"v": "no key"}')
    load()
    assert _set(tables.read(spark, target)) == [(1, "a"), (2, "B"), (3, "c")]
    assert [{k: c[k] for k in ("lines", "rows", "rejected", "updated", "inserted")} for c in seen] == [
        {"lines": 2, "rows": 2, "rejected": 0, "updated": 0, "inserted": 2},
        {"lines": 4, "rows": 4, "rejected": 1, "updated": 1, "inserted": 1},
    ]
    with pytest.raises(ValueError):
        incremental.load_stream(spark, str(source), empty.schema, target, empty, ["k"], str(tmp_path / "c"), order=[])


# -- answers --


def test_routes():
    assert answer.route("Which actors exploit CVE-2024-1?").route == "graph"
    assert answer.route("Explain the guidance").route == "text"
    assert answer.route("hello").route == "both"
    assert answer.route("x", lambda q: "nonsense").route == "both" and answer.route("x", lambda q: "text").route == "text"
    assert answer.route("x", lambda q: 1 / 0).route == "both" and answer.relevant("x", lambda q: 1 / 0)
    errors = []
    assert answer.pattern("x", lambda q, e: errors.append(e) or ("bad" if len(errors) < 3 else "uses")) == "uses" and len(errors) == 3
    assert answer.pattern("which group exploits it") == "exploits" and answer.pattern("hello") is None


def test_graph_answers_fall_back_to_text(spark, small):
    nodes, edges = small
    nodes = nodes.withColumn("is_kev", F.lit(False))
    text = lambda q: spark.createDataFrame([("chunk",)], "id string")
    assert answer.answer("who exploits it", nodes, edges, text, force="graph")["route"] == "graph"
    assert answer.answer("who targets it", nodes, edges, text, force="graph")["route"] == "text"
    assert answer.answer("who targets it", nodes, edges, text, force="graph", fallback=False)["text"] is None
    assert answer.answer("x", nodes, edges, text, judge=lambda q: False)["route"] == "rejected"


def test_brief(spark):
    items = spark.createDataFrame([("CVE-2", 2, "new"), ("CVE-1", 1, "known")], "cve_id string, tier int, tier_reason string")
    hits = spark.createDataFrame([("CVE-1", 2, "second"), ("CVE-1", 1, "first"), ("CVE-1", 9, "no")], "cve_id string, rank int, chunk_text string")
    text = answer.brief(answer.evidence_blocks(items, hits))
    assert text == "CVE-1 (tier 1: known)\n- first\n- second\n\nCVE-2 (tier 2: new)\n- no passages"
    sent = list(answer.events(["CVE-1"], text, 10))
    assert [k for k, _ in sent][:2] == ["meta", "cves"] and "".join(v for k, v in sent if k == "markdown") == text and sent[-1][0] == "done"
    assert answer.questions(items).count() == 2
