import datetime as dt
import json
import zipfile

import pytest

from lynceus import schemas
from lynceus.operators import merge, normalize
from lynceus.sources import feeds, tables


def metric(score, kind="Primary", source="nvd@nist.gov", **data):
    return {"source": source, "type": kind, "exploitabilityScore": 3.9, "impactScore": 5.9, "cvssData": {"baseScore": score, **data}}


def vulnerability(ident="CVE-2024-0001", **cve):
    base = {"id": ident, "published": "2024-01-02T03:04:05.000", "lastModified": "2024-01-02T23:30:00.000-02:00", "vulnStatus": "Analyzed", "descriptions": [{"lang": "es", "value": "x"}, {"lang": "en", "value": "text"}]}
    return {"cve": {**base, **cve}}


@pytest.fixture
def landed(tmp_path):
    def write(lines, name="2024-01.jsonl"):
        path = tmp_path / name
        path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
        return str(path)

    return write


def test_lines_that_don_t_parse_are_kept_apart(spark, landed):
    raw = feeds.ndjson(spark, landed([vulnerability(), "", "{broken"])).cache()
    assert raw.where("_bad is null").count() == 1 and raw.where("_bad = '{broken'").count() == 1


def test_scores_come_from_the_newest_usable_version(spark, landed):
    v31 = metric(9.8, baseSeverity="CRITICAL", attackVector="NETWORK")
    lines = [
        vulnerability("CVE-2024-0001", metrics={"cvssMetricV31": [metric(1.0, "Secondary"), v31], "cvssMetricV2": [metric(5.0)]}),
        vulnerability("CVE-2024-0002", metrics={"cvssMetricV40": [metric(8.7, baseSeverity="HIGH", userInteraction="PASSIVE")]}),
        vulnerability("CVE-2024-0003", metrics={"cvssMetricV31": [{"type": "Primary", "source": "nvd"}], "cvssMetricV2": [metric(6.9, accessVector="LOCAL", authentication="NONE")]}),
        vulnerability("CVE-2024-0004"),
        vulnerability("BAD"),
        vulnerability("CVE-2024-0005", metrics={"cvssMetricV31": [metric(11.0)]}),
    ]
    rows = {r.cve_id: r for r in normalize.vulnerabilities(feeds.ndjson(spark, landed(lines))).collect()}
    assert (rows["CVE-2024-0001"].cvss_version, rows["CVE-2024-0001"].cvss_score, rows["CVE-2024-0001"].cvss_severity, rows["CVE-2024-0001"].attack_vector) == ("3.1", 9.8, "CRITICAL", "NETWORK")
    assert (rows["CVE-2024-0002"].cvss_version, rows["CVE-2024-0002"].user_interaction) == ("4.0", "PASSIVE")
    assert (rows["CVE-2024-0003"].cvss_version, rows["CVE-2024-0003"].cvss_severity, rows["CVE-2024-0003"].attack_vector, rows["CVE-2024-0003"].privileges_required) == ("2.0", "MEDIUM", "LOCAL", "NONE")
    assert rows["CVE-2024-0004"].cvss_version is None
    assert rows["BAD"].reject_reason == "cve_id" and rows["CVE-2024-0005"].reject_reason == "score"
    assert rows["CVE-2024-0001"].last_modified == dt.datetime(2024, 1, 3, 1, 30) and rows["CVE-2024-0001"].description_en == "text"


def test_weaknesses_are_never_mixed(spark, landed):
    weak = lambda kind, *ids: {"type": kind, "description": [{"lang": "en", "value": i} for i in ids]}
    lines = [
        vulnerability("CVE-2024-0001", weaknesses=[weak("Secondary", "CWE-79")]),
        vulnerability("CVE-2024-0002", weaknesses=[weak("Secondary", "CWE-79"), weak("Primary", "CWE-120", "NVD-CWE-noinfo")]),
        vulnerability("CVE-2024-0003", references=[{"url": "u", "tags": ["Exploit"]}], configurations=[{"nodes": [{"cpeMatch": [{"vulnerable": True, "criteria": "cpe:x"}, {"vulnerable": False, "criteria": "cpe:y"}]}]}]),
    ]
    rows = {r.cve_id: r for r in normalize.vulnerabilities(feeds.ndjson(spark, landed(lines))).collect()}
    assert rows["CVE-2024-0001"].cwe_ids == ["CWE-79"] and rows["CVE-2024-0002"].cwe_ids == ["CWE-120"] and rows["CVE-2024-0003"].cwe_ids == []
    assert rows["CVE-2024-0003"].cpe_matches == ["cpe:x"] and rows["CVE-2024-0003"].has_exploit_ref and not rows["CVE-2024-0001"].has_exploit_ref


def test_mappings_are_distinct(spark):
    cves = spark.createDataFrame([("CVE-2024-0001", ["CWE-79", "CWE-79", ""]), ("CVE-2024-0001", ["CWE-89"]), ("", ["CWE-1"]), (None, ["CWE-2"])], "cve_id string, cwe_ids array<string>")
    assert sorted(r.mapping_id for r in normalize.weakness_mappings(cves).collect()) == ["CVE-2024-0001|CWE-79|nvd", "CVE-2024-0001|CWE-89|nvd"]


def test_exploited_list(spark, tmp_path):
    path = tmp_path / "kev.json"
    entry = lambda i, **k: {"cveID": i, "dateAdded": "2024-02-03", "vendorProject": "v" * 200, **k}
    path.write_text(json.dumps({"title": "x", "vulnerabilities": [entry(" cve-2024-0001 "), entry("CVE-2024-0001", dateAdded="soon", product=" "), entry("")]}))
    rows = normalize.exploited(feeds.exploited_list(spark, str(path)), "ordinal").collect()
    assert len(rows) == 1 and rows[0].kev_date_added is None and rows[0].kev_product is None and len(rows[0].kev_vendor_project) == 100
    path.write_text(json.dumps({"vulnerabilities": "none"}))
    assert feeds.exploited_list(spark, str(path)).count() == 0


def test_stix_bundle(spark, tmp_path):
    ref = lambda i: [{"source_name": "mitre-attack", "external_id": i}]
    objects = [
        {"id": "attack-pattern--1", "type": "attack-pattern", "name": "Parent", "external_references": ref("T1000")},
        {"id": "attack-pattern--2", "type": "attack-pattern", "name": "Child", "external_references": ref("T1000.001"), "x_mitre_is_subtechnique": True, "kill_chain_phases": [{"phase_name": "execution"}]},
        {"id": "attack-pattern--3", "type": "attack-pattern", "name": "Gone", "revoked": True, "external_references": ref("T1001")},
        {"id": "attack-pattern--4", "type": "attack-pattern", "name": "Keyless"},
        {"id": "intrusion-set--1", "type": "intrusion-set", "name": "Group", "aliases": ["G"], "external_references": ref("G1")},
        {"id": "course-of-action--1", "type": "course-of-action", "name": "Patch", "external_references": ref("M1")},
        {"id": "x-mitre-tactic--1", "type": "x-mitre-tactic", "name": "Execution", "x_mitre_shortname": "execution", "external_references": ref("TA1")},
        {"id": "campaign--1", "type": "campaign", "name": "C"},
        {"id": "relationship--1", "type": "relationship", "relationship_type": "subtechnique-of", "source_ref": "attack-pattern--2", "target_ref": "attack-pattern--1"},
        {"id": "relationship--2", "type": "relationship", "relationship_type": "uses", "source_ref": "intrusion-set--1", "target_ref": "attack-pattern--1"},
        {"id": "relationship--3", "type": "relationship", "relationship_type": "uses", "source_ref": "intrusion-set--1", "target_ref": "attack-pattern--9"},
    ]
    path = tmp_path / "attack.json"
    path.write_text(json.dumps({"objects": objects}))
    bundle = feeds.stix_objects(spark, str(path)).cache()
    found = {r.mitre_id: r for r in normalize.techniques(bundle).collect()}
    assert set(found) == {"T1000", "T1000.001"} and found["T1000.001"].parent_id == "T1000" and found["T1000.001"].tactic == "execution"
    assert [r.actor_id for r in normalize.actors(bundle).collect()] == ["G1"]
    assert [r.mitigation_id for r in normalize.mitigations(bundle).collect()] == ["M1"]
    assert [r.shortname for r in normalize.tactics(bundle).collect()] == ["execution"]
    assert [r.campaign_id for r in normalize.campaigns(bundle).collect()] == ["campaign--1"]
    assert sorted(r.relationship_type for r in normalize.relationships(bundle).collect()) == ["subtechnique-of", "uses"]


XML = """<?xml version="1.0"?><Weakness_Catalog xmlns="http://cwe.mitre.org/cwe-7"><Weaknesses>
<Weakness ID="79" Name="XSS" Abstraction="Base" Status="Stable"><Description>Hello <b>bold</b> &amp; world.</Description></Weakness>
<Weakness ID="x" Name="bad"/><Weakness ID="1" Name="old" Status="Deprecated"/></Weaknesses></Weakness_Catalog>"""


def test_weakness_catalogs(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("c.xml", XML)
    for name in ("a.xml", "b.zip"):
        rows = normalize.weaknesses(feeds.weaknesses_xml(spark, str(tmp_path / name))).collect()
        assert [(r.cwe_id, r.description) for r in rows] == [("CWE-79", "Hello bold & world.")]
    with pytest.raises(ValueError):
        feeds.weakness_rows(b"<a/>")
    for number, document in enumerate(({"weaknesses": [{"CWE_ID": 22, "Name": "n"}]}, {"other": 1, "Weaknesses": [{"ID": "cwe-22"}]}, [{"ID": "22"}])):
        (tmp_path / f"{number}.json").write_text(json.dumps(document))
        assert [r.cwe_id for r in normalize.weaknesses(feeds.weaknesses_json(spark, str(tmp_path / f"{number}.json"))).collect()] == ["CWE-22"]


@pytest.mark.parametrize("raw,want", [("79", "CWE-79"), ("079", "CWE-79"), ("cwe-22", "CWE-22"), ("CWE--5", "CWE-5"), (" ", None), (None, None), ("CWE-", None), ("abc", "CWE-abc")])
def test_weakness_ids(spark, raw, want):
    frame = spark.createDataFrame([(raw,)], "x string")
    assert frame.select(normalize.cwe_id(frame.x)).first()[0] == want


def test_descriptions(spark):
    frame = spark.createDataFrame([('{"#text": " a "}',), ('{"other": "b"}',), ('"c"',), ("plain text",), (None,)], "x string")
    assert [r[0] for r in frame.select(normalize.description_text(frame.x)).collect()] == ["a", "b", "c", "plain text", ""]


LIST = """<article class="c-teaser"><time datetime="2024-03-04T12:00:00Z"></time><div class="c-teaser__meta">Cybersecurity Advisory</div><h3 class="c-teaser__title"><a href="/news/aa24-001a">First</a></h3></article>
<article class="c-teaser"><time datetime="2024-03-01"></time><div class="c-teaser__meta">Analysis Report</div><h3 class="c-teaser__title"><a href="https://web.archive/2/https://site.example/ar/ar24-2b/">Second</a></h3></article>
<article class="c-teaser"><time datetime="2024-03-01"></time><div class="c-teaser__meta">Alert</div><h3 class="c-teaser__title"><a href="/x">No</a></h3></article><article><a href="/y">no</a></article>"""


def test_list_pages(spark):
    found = feeds.listings(spark.createDataFrame([(LIST,), (None,)], "html string"), "https://site.example").cache()
    rows = {r.advisory_id: (r.title, r.url, r.published_date, r.advisory_type) for r in found.collect()}
    assert rows == {"aa24-001a": ("First", "https://site.example/news/aa24-001a", dt.date(2024, 3, 4), "cybersecurity_advisory"), "ar24-2b": ("Second", "https://site.example/ar/ar24-2b/", dt.date(2024, 3, 1), "analysis_report")}
    known = spark.createDataFrame([("ar24-2b",)], "advisory_id string")
    assert [r.advisory_id for r in feeds.to_fetch(found, known).collect()] == ["aa24-001a"]
    assert feeds.to_fetch(found, known, dt.date(2024, 4, 1)).count() == 0


def test_monthly_files_and_pages(spark, landed, tmp_path):
    landed([vulnerability()], "2024-01.jsonl")
    landed([vulnerability("CVE-2024-0009")], "2024-13.jsonl")
    assert [(r.month, r.cve.id) for r in feeds.monthly(spark, str(tmp_path / "*.jsonl")).collect()] == [("2024-01", "CVE-2024-0001")]
    assert feeds.single(feeds.ndjson(spark, str(tmp_path / "*.jsonl")), " cve-2024-0009").count() == 1
    assert feeds.changed_between(feeds.ndjson(spark, str(tmp_path / "*.jsonl")), dt.date(2024, 1, 3), dt.date(2024, 1, 9)).count() == 0
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "aa24-001a.html").write_text("<p>é</p>")
    assert [tuple(r) for r in feeds.pages(spark, str(tmp_path / "pages")).collect()] == [("aa24-001a", "<p>é</p>")]


def test_versions_and_pointer(spark, tmp_path):
    path = str(tmp_path / "t")
    assert not tables.exists(spark, path)
    for n in range(4):
        tables.change(spark, path, spark.range(0), lambda t: t.unionByName(spark.range(n, n + 1)))
    assert sorted(r.id for r in tables.read(spark, path).collect()) == [0, 1, 2, 3]
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("v=")) == ["v=2", "v=3"]
    with pytest.raises(FileNotFoundError):
        tables.read(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("step", ["after the rows", "before the number", "after the number"])
def test_a_crash_loses_no_version(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "t")
    tables.write(spark.range(3), path)
    tables.write(spark.range(4), path)

    def crash(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(tables, {"after the rows": "_commit", "before the number": "_save", "after the number": "_forget"}[step], crash)
        with pytest.raises(KeyboardInterrupt):
            tables.change(spark, path, spark.range(0), lambda t: t.where("id < 1"))
    if step == "before the number":
        (tmp_path / "t" / "_versions" / "2.new").write_text("half a fi")
    assert tables.read(spark, path).count() == (1 if step == "after the number" else 4)
    tables.change(spark, path, spark.range(0), lambda t: t.unionByName(spark.range(10, 12)))
    assert tables.read(spark, path).count() == (3 if step == "after the number" else 6)
    for x in (tmp_path / "t" / "_versions").iterdir():
        x.unlink()
    with pytest.raises(RuntimeError):
        tables.exists(spark, path)


def test_only_touched_buckets_are_written(spark, tmp_path):
    path, empty = str(tmp_path / "t"), spark.createDataFrame([], "k long, v string")
    load = lambda rows, how=lambda t, b: merge.upsert(t, b, ["k"]): tables.change_keys(spark, path, empty, ["k"], spark.createDataFrame(rows, "k long, v string"), how, buckets=16)
    load([(k, "a") for k in range(200)] + [(None, "n")])
    before = tables._places(spark, path, 0)
    load([(5, "b"), (None, "m"), (500, "c")])
    after = tables._places(spark, path, 1)
    assert set(after) == set(before) and 0 < sum(after[k] != before[k] for k in after) <= 3
    assert {r.k: r.v for r in tables.read(spark, path).collect()} == {**{k: "a" for k in range(200)}, 5: "b", None: "m", 500: "c"}
    load([(k, "x") for k in range(100)], lambda t, b: merge.delete_where_in(t, b, ["k"]))
    assert tables.read(spark, path).count() == 102
    load([(7, "back")])
    used = {x.parent.name + "/" + x.name for x in (tmp_path / "t").glob("v=*/_bucket=*")}
    assert set(tables._places(spark, path, 3).values()) <= used  # and what nobody needs is gone
    assert not used - {x for n in (2, 3) for x in tables._places(spark, path, n).values()}
    assert tables.read(spark, path).schema == empty.schema


def test_export_and_schema_evolution(spark, tmp_path):
    tables.export_tsv(spark.createDataFrame([("a", "actor")], "name string, type string"), str(tmp_path / "x"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "x")).first().type == "actor"
    once = schemas.evolve(spark.range(1), "id BIGINT, flag BOOLEAN")
    assert schemas.evolve(once, "id BIGINT, flag BOOLEAN").columns == once.columns == ["id", "flag"]
    table = schemas.TABLES["cve_records"]
    assert schemas.conform(spark.range(1), table).columns == table.names == table.columns.names
    assert set(table.owned["nvd"]).isdisjoint(table.owned["kev"])
    assert all(t.columns.names == t.names for t in schemas.TABLES.values())
