"""Feeds to rows: vulnerabilities, exploited-vulnerability lists, STIX objects, weaknesses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.operators.merge import last_by_key

CVE_ID = r"^CVE-[0-9]{4}-[0-9]+$"


def blank_to_null(value: Column, width: int | None = None) -> Column:
    """Trimmed, null if nothing is left, cut to ``width``."""
    text = F.nullif(F.trim(value), F.lit(""))
    return text if width is None else F.left(text, F.lit(width))


def clip(value: Column, width: int) -> Column:
    return F.nullif(F.left(value, F.lit(width)), F.lit(""))


def iso_date(value: Column) -> Column:
    """A date written as ``YYYY-MM-DD``, else null."""
    return F.when(value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(value, "yyyy-MM-dd"))


def naive_utc(value: Column) -> Column:
    """ISO timestamp, with or without an offset, as a time without zone in UTC."""
    text = F.trim(value)
    zoned = F.when(text.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.to_utc_timestamp(zoned.try_cast("timestamp"), F.current_timezone()).cast("timestamp_ntz")


def primary_metric(metrics: Column) -> Column:
    """The primary metric of the national database, else any primary one, else the first."""
    primary = lambda m: m["type"] == "Primary"
    own = lambda m: primary(m) & F.contains(F.lower(F.coalesce(m["source"], F.lit(""))), F.lit("nvd"))
    return F.coalesce(F.get(F.filter(metrics, own), 0), F.get(F.filter(metrics, primary), 0), F.get(metrics, 0))


def v2_severity(score: Column) -> Column:
    return F.when(score < 4, "LOW").when(score < 7, "MEDIUM").when(score.isNotNull(), "HIGH")


_FLAT = (("attack_vector", "attackVector", 20), ("attack_complexity", "attackComplexity", 10), ("privileges_required", "privilegesRequired", 10), ("user_interaction", "userInteraction", 10), ("scope", "scope", 10), ("confidentiality_impact", "confidentialityImpact", 10), ("integrity_impact", "integrityImpact", 10))
_V2 = {"attack_vector": "accessVector", "attack_complexity": "accessComplexity", "privileges_required": "authentication", "user_interaction": None, "scope": None}


def _flat_cvss(picked: Column) -> Column:
    """The scores of a struct of a version and its metric."""
    metric, data = picked["metric"], picked["metric"]["cvssData"]
    old = picked["version"] == "2.0"

    def part(name: str, source: str, width: int) -> Column:
        other = _V2.get(name, source)
        value = data[source] if other == source else F.when(~old, data[source]).otherwise(F.lit(None).cast("string") if other is None else data[other])
        return clip(value, width).alias(name)

    return F.struct(
        picked["version"].alias("cvss_version"),
        data["baseScore"].alias("cvss_score"),
        F.when(old, v2_severity(data["baseScore"])).otherwise(clip(data["baseSeverity"], 10)).alias("cvss_severity"),
        *[part(*x) for x in _FLAT],
        metric["exploitabilityScore"].alias("exploitability_score"),
        metric["impactScore"].alias("impact_score"),
    )


def cvss(metrics: Column) -> Column:
    """Flat scores of the first version, of 3.1, 4.0, 3.0 and 2.0, whose picked metric has data."""
    order = (("cvssMetricV31", "3.1"), ("cvssMetricV40", "4.0"), ("cvssMetricV30", "3.0"), ("cvssMetricV2", "2.0"))
    picked = F.array(*[F.struct(F.lit(version).alias("version"), primary_metric(metrics[name]).alias("metric")) for name, version in order])
    # a lambda's variable is computed once, a column each time that it is named
    return F.get(F.transform(F.filter(picked, lambda p: p["metric"]["cvssData"].isNotNull()), _flat_cvss), 0)


def weakness_ids(weaknesses: Column) -> Column:
    """English ids of the primary weaknesses, of the secondary ones only if there are none."""

    def of(kind: str) -> Column:
        wanted = F.filter(F.coalesce(weaknesses, F.array()), lambda w: F.trim(w["type"]) == kind)
        texts = F.flatten(F.transform(wanted, lambda w: F.coalesce(F.transform(F.filter(w["description"], lambda d: d["lang"] == "en"), lambda d: F.trim(d["value"])), F.array().cast("array<string>"))))
        return F.transform(F.filter(texts, lambda v: F.startswith(v, F.lit("CWE-"))), lambda v: F.left(v, F.lit(20)))

    primary, secondary = of("Primary"), of("Secondary")
    return F.when(F.size(primary) > 0, primary).otherwise(secondary)


def vulnerable_products(configurations: Column) -> Column:
    none = F.array().cast("array<string>")
    nodes = F.flatten(F.transform(F.coalesce(configurations, F.array()), lambda c: F.coalesce(c["nodes"], F.array())))
    per_node = F.transform(nodes, lambda n: F.coalesce(F.transform(F.filter(n["cpeMatch"], lambda m: m["vulnerable"] & (m["criteria"] != "")), lambda m: F.left(m["criteria"], F.lit(500))), none))
    return F.coalesce(F.flatten(per_node), none)


def has_exploit_reference(references: Column) -> Column:
    return F.coalesce(F.exists(references, lambda r: F.coalesce(F.array_contains(r["tags"], "Exploit"), F.lit(False))), F.lit(False))


def vulnerabilities(raw: DataFrame) -> DataFrame:
    """Feed lines to rows, with ``reject_reason`` null on valid ones."""
    cve = F.col("cve")
    english = F.get(F.filter(cve["descriptions"], lambda d: d["lang"] == "en"), 0)["value"]
    rows = raw.select(
        cve["id"].alias("cve_id"),
        F.nullif(cve["sourceIdentifier"], F.lit("")).alias("source_identifier"),
        iso_date(F.left(cve["published"], F.lit(10))).alias("published_date"),
        naive_utc(cve["lastModified"]).alias("last_modified"),
        F.left(F.coalesce(cve["vulnStatus"], F.lit("")), F.lit(50)).alias("vuln_status"),
        F.left(F.coalesce(english, F.lit("")), F.lit(16000)).alias("description_en"),
        cvss(cve["metrics"]).alias("_cvss"),
        weakness_ids(cve["weaknesses"]).alias("cwe_ids"),
        vulnerable_products(cve["configurations"]).alias("cpe_matches"),
        has_exploit_reference(cve["references"]).alias("has_exploit_ref"),
    )
    names = ["cvss_version", "cvss_score", "cvss_severity", *[n for n, _, _ in _FLAT], "exploitability_score", "impact_score"]
    rows = rows.select("*", *[F.col(f"_cvss.{n}").alias(n) for n in names]).drop("_cvss")
    return rows.withColumn("reject_reason", reject_reason())


def reject_reason() -> Column:
    """Why a vulnerability row isn't valid; null if it is."""
    in_range = lambda c: F.col(c).isNull() | F.col(c).between(0, 10)
    return (
        F.when(F.col("cve_id").isNull() | ~F.col("cve_id").rlike(CVE_ID) | (F.length("cve_id") > 20), "cve_id")
        .when(F.col("published_date").isNull(), "published_date")
        .when(F.col("last_modified").isNull(), "last_modified")
        .when(F.length("source_identifier") > 100, "source_identifier")
        .when(~in_range("cvss_score") | ~in_range("exploitability_score") | ~in_range("impact_score"), "score")
    )


def split_valid(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected ones with their reason."""
    return rows.where("reject_reason is null").drop("reject_reason"), rows.where("reject_reason is not null")


def validity_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("lines_in"), F.count_if(F.col("reject_reason").isNull()).alias("accepted"), F.count_if(F.col("reject_reason").isNotNull()).alias("skipped"))


def weakness_mappings(cves: DataFrame) -> DataFrame:
    """``mapping_id, cve_id, cwe_id, source``, each pair once, empty ids left out."""
    pairs = cves.select(F.col("cve_id"), F.explode("cwe_ids").alias("cwe_id")).where("cve_id <> '' and cwe_id <> ''").distinct()
    return pairs.select(F.concat_ws("|", "cve_id", "cwe_id", F.lit("nvd")).alias("mapping_id"), "cve_id", "cwe_id", F.lit("nvd").alias("source"))


def exploited(entries: DataFrame, ordinal: str | None = None) -> DataFrame:
    """Exploited-vulnerability entries to rows; of entries with one id the last in ``ordinal`` counts."""
    rows = entries.select(
        F.upper(F.trim("cveID")).alias("cve_id"),
        iso_date(F.col("dateAdded")).alias("kev_date_added"),
        blank_to_null(F.col("knownRansomwareCampaignUse"), 50).alias("kev_ransomware_use"),
        blank_to_null(F.col("requiredAction")).alias("kev_required_action"),
        iso_date(F.col("dueDate")).alias("kev_due_date"),
        blank_to_null(F.col("vendorProject"), 100).alias("kev_vendor_project"),
        blank_to_null(F.col("product"), 100).alias("kev_product"),
        *([F.col(ordinal).alias("_ordinal")] if ordinal else []),
    ).where("cve_id <> ''")
    return last_by_key(rows, ["cve_id"], ["_ordinal"]).drop("_ordinal") if ordinal else last_by_key(rows, ["cve_id"])


def external_id(references: Column) -> Column:
    return F.get(F.filter(references, lambda r: (r["source_name"] == "mitre-attack") & (r["external_id"] != "")), 0)["external_id"]


def live(objects: DataFrame, kind: str) -> DataFrame:
    """STIX objects of a type that are neither deprecated nor revoked."""
    off = F.coalesce("x_mitre_deprecated", F.lit(False)) | F.coalesce("revoked", F.lit(False))
    return objects.where((F.col("type") == kind) & ~off)


def _body() -> Column:
    return F.left(F.coalesce("description", F.lit("")), F.lit(4000)).alias("description")


def _mitre_id() -> Column:
    return F.coalesce(F.nullif("x_mitre_id", F.lit("")), external_id(F.col("external_references")))


def technique_parents(objects: DataFrame) -> DataFrame:
    """``stix_id, parent_id`` for sub-techniques whose parent is known."""
    named = live(objects, "attack-pattern").select(F.col("id").alias("target_ref"), _mitre_id().alias("parent_id")).where("parent_id is not null")
    links = live(objects, "relationship").where("relationship_type = 'subtechnique-of'").select(F.col("source_ref").alias("stix_id"), "target_ref")
    return links.join(named, "target_ref").select("stix_id", "parent_id").groupBy("stix_id").agg(F.max("parent_id").alias("parent_id"))


def techniques(objects: DataFrame) -> DataFrame:
    rows = live(objects, "attack-pattern").select(
        _mitre_id().alias("mitre_id"), F.col("id").alias("stix_id"), "name", _body(), F.get("kill_chain_phases", F.lit(0))["phase_name"].alias("tactic"),
        F.coalesce("x_mitre_platforms", F.array().cast("array<string>")).alias("platforms"), F.coalesce("x_mitre_is_subtechnique", F.lit(False)).alias("is_subtechnique"), F.col("x_mitre_version").alias("version"),
    )
    return rows.where("mitre_id is not null").join(technique_parents(objects), "stix_id", "left")


def actors(objects: DataFrame) -> DataFrame:
    return live(objects, "intrusion-set").select(F.col("name").alias("actor_name"), F.col("id").alias("stix_id"), external_id(F.col("external_references")).alias("actor_id"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), _body()).where("actor_name is not null")


def mitigations(objects: DataFrame) -> DataFrame:
    return live(objects, "course-of-action").select(external_id(F.col("external_references")).alias("mitigation_id"), F.col("id").alias("stix_id"), "name", _body()).where("mitigation_id is not null")


def tactics(objects: DataFrame) -> DataFrame:
    return live(objects, "x-mitre-tactic").select(external_id(F.col("external_references")).alias("tactic_id"), F.col("id").alias("stix_id"), "name", F.col("x_mitre_shortname").alias("shortname"), F.lit(None).cast("int").alias("tactic_order")).where("tactic_id is not null")


def campaigns(objects: DataFrame) -> DataFrame:
    return live(objects, "campaign").select(F.coalesce(external_id(F.col("external_references")), "id").alias("campaign_id"), F.col("id").alias("stix_id"), "name", _body(), iso_date(F.left("first_seen", F.lit(10))).alias("first_seen"), iso_date(F.left("last_seen", F.lit(10))).alias("last_seen")).where("campaign_id is not null")


def relationships(objects: DataFrame) -> DataFrame:
    """Relationships of which both ends are live, named objects; one row for each id."""
    off = F.coalesce("x_mitre_deprecated", F.lit(False)) | F.coalesce("revoked", F.lit(False))
    names = objects.where(~off & (F.col("type") != "relationship") & (F.col("name") != "")).select("id", "name")
    links = live(objects, "relationship").select("source_ref", "target_ref", "relationship_type")
    rows = links.join(names.select(F.col("id").alias("source_ref"), F.col("name").alias("source_name")), "source_ref").join(names.select(F.col("id").alias("target_ref"), F.col("name").alias("target_name")), "target_ref")
    kind = lambda c: F.replace(F.split_part(F.col(c), F.lit("--"), F.lit(1)), F.lit("-"), F.lit("_"))
    rows = rows.select(
        F.concat_ws("_", "source_ref", "target_ref", F.coalesce("relationship_type", F.lit(""))).alias("relationship_id"),
        "source_name", kind("source_ref").alias("source_type"), "target_name", kind("target_ref").alias("target_type"), "relationship_type",
    )
    return rows.dropDuplicates(["relationship_id"])


def attack_tables(objects: DataFrame) -> dict[str, DataFrame]:
    """The six tables of a STIX bundle, under their names."""
    made = {"attack_techniques": techniques, "attack_actors": actors, "attack_mitigations": mitigations, "attack_tactics": tactics, "attack_campaigns": campaigns, "attack_relationships": relationships}
    return {name: how(objects) for name, how in made.items()}


def cwe_id(raw: Column) -> Column:
    """``79``, ``"079"``, ``"cwe-79"`` to ``CWE-79``; null if nothing is left."""
    text = F.trim(raw.cast("string"))
    rest = F.regexp_replace(F.trim(F.substring(text, 5, 1 << 20)), "^-+", "")
    number = F.regexp_replace(text, r"^[+]?0*([0-9]+)$", "$1")
    return F.when(F.upper(text).startswith("CWE-"), F.when(rest != "", F.concat(F.lit("CWE-"), rest))).when(text != "", F.concat(F.lit("CWE-"), number))


def weaknesses(catalog: DataFrame) -> DataFrame:
    """Catalog rows ``CWE_ID, Name, Abstraction, Status, Description`` without deprecated and nameless ones."""
    status = F.trim(F.coalesce("Status", F.lit("")))
    text = lambda c, n: F.left(F.coalesce(c, F.lit("")), F.lit(n))
    rows = catalog.where(status != "Deprecated").select(
        cwe_id(F.col("CWE_ID")).alias("cwe_id"), text("Name", 300).alias("name"), text("Abstraction", 20).alias("abstraction"), F.left(status, F.lit(30)).alias("status"), F.left(F.trim(F.coalesce("Description", F.lit(""))), F.lit(16000)).alias("description"), F.lit(False).alias("is_deprecated"),
    )
    return rows.where("cwe_id is not null")


def weakness_counts(catalog: DataFrame) -> DataFrame:
    kept = (F.trim(F.coalesce("Status", F.lit(""))) != "Deprecated") & cwe_id(F.col("CWE_ID")).isNotNull()
    return catalog.agg(F.count("*").alias("raw"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("skipped"))


def description_text(value: Column) -> Column:
    """A description that is a JSON string or an object: the text under its usual keys, else any text in it, else the JSON."""
    v = F.try_parse_json(value)
    keys = [F.try_variant_get(v, path, "string") for path in ("$['#text']", "$.text", "$.content", "$.value")]
    entries = F.try_variant_get(v, "$", "map<string,string>")
    any_text = F.get(F.filter(F.map_values(entries), lambda x: F.trim(x) != ""), 0)
    is_object = F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
    return F.trim(F.when(v.isNull(), F.coalesce(value, F.lit(""))).when(is_object, F.coalesce(*keys, any_text, value)).otherwise(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))))


def graph_row(cves: DataFrame) -> DataFrame:
    """Vulnerability rows as node properties: ISO dates, bounded text, flags never null."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return cves.select(
        F.col("cve_id").alias("key"), F.date_format("published_date", "yyyy-MM-dd").alias("published_date"), F.date_format("last_modified", "yyyy-MM-dd'T'HH:mm:ss").alias("last_modified"),
        F.left("description_en", F.lit(28000)).alias("description"), F.col("vuln_status"), F.col("cvss_score"), F.col("cvss_severity"), flag("has_exploit_ref"), flag("is_kev"),
    )


def risk_score(cves: DataFrame) -> Column:
    """Up to 100: half by score, 25 if exploited, 15 if an exploit is known, 10 or 5 by attack vector."""
    vector = F.upper("attack_vector")
    return F.least(F.coalesce(F.col("cvss_score"), F.lit(0.0)) / 10 * 50 + F.when(F.col("is_kev"), 25).otherwise(0) + F.when(F.col("has_exploit_ref"), 15).otherwise(0) + F.when(vector == "NETWORK", 10).when(F.startswith(vector, F.lit("ADJACENT")), 5).otherwise(0), F.lit(100.0))


def id_or_null(value: Column, kind: str) -> Column:
    """Trimmed id in its canonical case, null if it isn't one."""
    pattern = {"cve": CVE_ID, "technique": r"^T[0-9]{4,5}(\.[0-9]{3})?$", "advisory": r"^[a-z0-9][a-z0-9-]{0,63}$"}[kind]
    text = F.trim(value)
    text = text if kind == "advisory" else F.upper(text)
    return F.when(text.rlike(pattern), text)
