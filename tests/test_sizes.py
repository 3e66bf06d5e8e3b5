"""Queries on tables that are larger than the smallest ones, or cut into more parts."""

import os

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lynceus.operators import evaluate, graph, search, sections
from lynceus.plans import catalog, common, landed, services
from lynceus.sources import feeds

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def more_questions(sf_dir, tmp_path_factory):
    """The smallest tables, with the benchmark three times under shifted numbers."""
    folder = tmp_path_factory.mktemp("more")
    for name in TABLES:
        if name != "benchmark":
            os.symlink(f"{sf_dir}/{name}.parquet", folder / f"{name}.parquet")
    times = "SELECT b.* REPLACE (item_id + k * (SELECT max(item_id) + 1 FROM '{0}') AS item_id) FROM '{0}' b, range(3) r(k)".format(f"{sf_dir}/benchmark.parquet")
    duckdb.connect().execute(f"COPY ({times}) TO '{folder}/benchmark.parquet' (FORMAT parquet)")
    return str(folder)


def _oracle(name, folder):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection.execute(catalog.ORACLE_SQL[name]).df()


@pytest.mark.parametrize("name", ["txt_hybrid_rrf", "txt_hybrid_filtered"])
def test_every_question_is_asked(name, spark, more_questions, same):
    found = catalog.QUERIES[name](spark, more_questions).toPandas()
    assert found["query_id"].max() >= 40
    same(found, _oracle(name, more_questions))


def test_every_question_has_its_vector(spark, more_questions):
    found = catalog.QUERIES["txt_hybrid_rrf"](spark, more_questions).toPandas()
    assert found.loc[found["vec_rank"] > 0, "query_id"].max() >= 40


def test_a_bucket_is_written_in_slices(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(k, f"common word{k % 7} common") for k in range(200)], "id long, text string")
    plain = search.build(docs, "id", "text", str(tmp_path / "plain"))
    monkeypatch.setattr(search, "CHARACTERS_PER_TASK", 40, raising=False)
    cut = search.build(docs, "id", "text", str(tmp_path / "cut"))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(plain.postings) == rows(cut.postings) and rows(plain.terms) == rows(cut.terms) and rows(plain.mean) == rows(cut.mean)
    largest = max(spark.read.parquet(f).count() for f in cut.postings.where("term = 'common'").inputFiles())
    assert largest < 100


def test_scores_are_made_in_tiles(spark, monkeypatch):
    pool = spark.createDataFrame([(k, [float(k % 7), float(k % 5), 1.0]) for k in range(60)], "id int, v array<float>")
    asked = pool.selectExpr("id AS query_id", "v AS vector")
    near = lambda: sorted(tuple(r) for r in search.nearest(asked, pool, 5, id_col="id", vector_col="v", exclude_self=True).select("query_id", "id", "rank").collect())
    whole, plain = near(), search._best_so_far

    def small(best, score, k):
        assert score.shape[0] <= 8 and score.shape[1] <= 8
        return plain(best, score, k)

    monkeypatch.setattr(search, "TILE", 8, raising=False)
    monkeypatch.setattr(search, "_best_so_far", small)
    assert near() == whole


def test_a_common_product_is_met_by_many_tasks(spark):
    edges = [(f"adv{k}", "Actor", f"A{k}", "EXPLOITS", "CVE", "C1") for k in range(300)] + [(f"adv{k}", "CVE", "C1", "AFFECTS", "Other", "Maker Server") for k in range(300)]
    # two products of one source hold the maker's name, and one vulnerability is its own sibling
    edges += [("adv0", "Actor", "A0", "EXPLOITS", "CVE", "C2"), ("adv0", "CVE", "C2", "AFFECTS", "Other", "Maker Desk")]
    rows = spark.createDataFrame(edges, "advisory_id string, src_label string, src_key string, rel string, dst_label string, dst_key string")
    siblings = spark.createDataFrame([("C1", "maker", "none"), ("C2", "maker", ""), ("C3", "maker", "desk")], "cve_id string, kev_vendor_project string, kev_product string")
    found = graph.bridges(rows, siblings)
    want = {(f"A{k}", t, f"adv{k}", "existing" if (k, t) in {(0, "C1"), (0, "C2")} else "new") for k in range(300) for t in ("C1", "C2", "C3") if t != "C1" or k == 0}
    got = [(r.src_key, r.target, r.advisory_id, r.status) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
    assert found.select(F.spark_partition_id()).distinct().count() > 4


def test_a_list_page_is_not_held_as_a_tree():
    def page(n):
        part = '<article class="c-teaser"><time datetime="2024-03-01"></time><div class="c-teaser__meta">Analysis Report</div><h3 class="c-teaser__title"><a href="/a/x{0}"> large &amp; ring {0} </a></h3></article>'
        return "<html><body>" + "".join(part.format(k) for k in range(n)) + "</body></html>"

    found = feeds.listing(page(3000), "https://site.example")
    assert [(r[0], r[1]) for r in found] == [(f"x{k}", f"large & ring {k}") for k in range(3000)]
    html, most = page(20_000), []
    for number, _ in enumerate(reader := feeds._Articles().articles(html)):
        if number % 1000 == 0:
            most.append(sum(1 for x in reader.gi_frame.f_locals["self"].root.all("article")))
    assert number == 19_999 and max(most) <= 1


def test_list_pages_grow_in_number_only(spark, tmp_path):
    spark.range(2000).selectExpr("id AS p_partkey", "'name' AS p_name").write.parquet(str(tmp_path / "part.parquet"))
    assert landed._list_pages(spark, str(tmp_path)).selectExpr("max(length(html))").first()[0] < 100 * 400


def test_attack_objects_are_dealt_by_their_rows(spark, sf_dir, monkeypatch, same):
    whole = catalog.QUERIES["snk_attack_tables"](spark, sf_dir).toPandas()
    monkeypatch.setattr(common, "ROWS_PER_TASK", 20, raising=False)
    assert services._objects(spark, sf_dir).rdd.getNumPartitions() >= 10  # 200 parts in one file
    same(catalog.QUERIES["snk_attack_tables"](spark, sf_dir).toPandas(), whole)


@pytest.mark.parametrize("name", ["doc_sections", "doc_flat_sections"])
def test_made_pages_are_dealt_by_their_rows(name, spark, sf_dir, monkeypatch):
    monkeypatch.setattr(common, "ROWS_PER_TASK", 20, raising=False)
    assert catalog.QUERIES[name](spark, sf_dir).rdd.getNumPartitions() >= 10  # 200 parts in one file


def test_few_pages_are_parsed_at_once(spark):
    batch = pa.RecordBatch.from_arrays([pa.array(range(300))], names=["n"])
    parts = list(sections._small([batch]))
    assert max(b.num_rows for b in parts) <= 128 and pa.Table.from_batches(parts).column(0).to_pylist() == list(range(300))
    pages = spark.range(300).selectExpr("id AS advisory_id", "concat('<main><p>text ', id, '</p></main>') AS html").coalesce(1)
    assert sorted((r.advisory_id, r.text) for r in sections.split(pages, type_col=None).collect()) == [(k, f"text {k}") for k in range(300)]


def test_an_advisory_costs_a_row_and_not_a_call(spark, capsys):
    kind = "advisory_id string, ordinal long, subject string, relation string, object string"
    gold = spark.createDataFrame([(f"a{k}", n, f"Group {n}", "uses", f"tool {n}x") for k in range(40) for n in range(3)] + [("gold only", 1, "s", "uses", None), (None, 2, "abc", "uses", "def")], kind)
    predicted = spark.createDataFrame([(f"a{k}", n, f"group{n} ", "uses", f"TOOL {n}X") for k in range(40) for n in range(2)] + [("predicted only", 1, "s", "uses", "o"), (None, 1, "abc", "uses", "def")], kind)
    found = evaluate.extraction(gold, predicted)
    got = {r.advisory_id: (r.matched, r.gold, r.predicted, round(r.f1, 6)) for r in found.collect()}
    assert got == {**{f"a{k}": (2, 3, 2, 0.8) for k in range(40)}, "gold only": (0, 1, 0, 0.0), "predicted only": (0, 0, 1, 0.0), None: (1, 1, 1, 1.0)}
    found.explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan and "CoGroup" not in plan


def test_rows_are_not_sent_more_often_the_more_there_are(spark, monkeypatch):
    rows = spark.createDataFrame([(k, [float(k % 7), float(k % 5), 1.0]) for k in range(60)], "id int, v array<float>")
    pairs = lambda: sorted((r.a, r.b) for r in search.similar_pairs(rows, 0.99, id_col="id", vector_col="v", block=2).collect())
    whole = pairs()
    for name, value in (("MOST_BLOCKS", 3), ("TILE", 8)):
        monkeypatch.setattr(search, name, value, raising=False)
    assert pairs() == whole and search._blocks(rows.toDF("id", "v"), 2)[1] == 3


def test_a_catalog_is_not_held_as_a_tree():
    item = '<Weakness ID="{0}" Name="n" Abstraction="Base" Status="Draft"><Description> about <b>{0}</b> things </Description></Weakness>'
    data = ('<c xmlns="http://cwe.mitre.org/cwe-7"><Other><Weakness ID="9"/></Other><Weaknesses>' + "".join(item.format(k) for k in range(3000)) + "</Weaknesses></c>").encode()
    assert [(r[0], r[4]) for r in feeds.weakness_rows(data)] == [(str(k), f"about {k} things") for k in range(3000)]
    reader = feeds._weaknesses(data)
    assert max(len(list(reader.gi_frame.f_locals["above"][-1][1])) for _ in reader) < 1000  # a parser reads some way ahead
