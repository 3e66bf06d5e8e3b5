"""Tables of the data model: columns, key, and which feed owns which columns.

Schemas are DDL strings, so that they are there before a session is.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


_CVSS = (
    "source STRING, type STRING, exploitabilityScore DOUBLE, impactScore DOUBLE, baseSeverity STRING, cvssData STRUCT<version: STRING, vectorString: STRING, "
    "attackVector: STRING, attackComplexity: STRING, privilegesRequired: STRING, userInteraction: STRING, scope: STRING, confidentialityImpact: STRING, "
    "integrityImpact: STRING, availabilityImpact: STRING, baseScore: DOUBLE, baseSeverity: STRING, accessVector: STRING, accessComplexity: STRING, authentication: STRING, "
    "vulnConfidentialityImpact: STRING, vulnIntegrityImpact: STRING, vulnAvailabilityImpact: STRING>"
)
_METRIC = "ARRAY<STRUCT<" + _CVSS.replace("source STRING, type STRING, exploitabilityScore DOUBLE, impactScore DOUBLE, baseSeverity STRING, cvssData STRUCT", "source: STRING, type: STRING, exploitabilityScore: DOUBLE, impactScore: DOUBLE, baseSeverity: STRING, cvssData: STRUCT") + ">>"

#: One line of a landed vulnerability feed.
NVD = (
    "cve STRUCT<id: STRING, sourceIdentifier: STRING, published: STRING, lastModified: STRING, vulnStatus: STRING, "
    "descriptions: ARRAY<STRUCT<lang: STRING, value: STRING>>, "
    f"metrics: STRUCT<cvssMetricV31: {_METRIC}, cvssMetricV40: {_METRIC}, cvssMetricV30: {_METRIC}, cvssMetricV2: {_METRIC}>, "
    "weaknesses: ARRAY<STRUCT<type: STRING, description: ARRAY<STRUCT<lang: STRING, value: STRING>>>>, "
    "configurations: ARRAY<STRUCT<nodes: ARRAY<STRUCT<cpeMatch: ARRAY<STRUCT<vulnerable: BOOLEAN, criteria: STRING>>>>>>, "
    "references: ARRAY<STRUCT<url: STRING, tags: ARRAY<STRING>>>>"
)

KEV = ("cveID STRING, dateAdded STRING, dueDate STRING, requiredAction STRING, knownRansomwareCampaignUse STRING, vendorProject STRING, product STRING")

STIX = (
    "id STRING, type STRING, name STRING, description STRING, aliases ARRAY<STRING>, x_mitre_id STRING, x_mitre_shortname STRING, x_mitre_platforms ARRAY<STRING>, "
    "x_mitre_is_subtechnique BOOLEAN, x_mitre_deprecated BOOLEAN, revoked BOOLEAN, x_mitre_version STRING, first_seen STRING, last_seen STRING, "
    "external_references ARRAY<STRUCT<source_name: STRING, external_id: STRING>>, kill_chain_phases ARRAY<STRUCT<kill_chain_name: STRING, phase_name: STRING>>, "
    "source_ref STRING, target_ref STRING, relationship_type STRING"
)


@dataclass(frozen=True)
class Table:
    """A table's columns, its key, and the columns that each feed may change."""

    name: str
    ddl: str
    key: tuple[str, ...]
    owned: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return [column.split()[0] for column in self.ddl.split(", ")]

    @property
    def columns(self) -> StructType:
        """The columns' types; needs a session, which parses them."""
        return StructType.fromDDL(self.ddl)


_KEV_COLUMNS = ("is_kev", "kev_date_added", "kev_ransomware_use", "kev_required_action", "kev_due_date", "kev_vendor_project", "kev_product")
_CVE = (
    "cve_id STRING, source_identifier STRING, published_date DATE, last_modified TIMESTAMP_NTZ, vuln_status STRING, description_en STRING, cvss_version STRING, cvss_score DOUBLE, "
    "cvss_severity STRING, attack_vector STRING, attack_complexity STRING, privileges_required STRING, user_interaction STRING, scope STRING, confidentiality_impact STRING, "
    "integrity_impact STRING, availability_impact STRING, exploitability_score DOUBLE, impact_score DOUBLE, cwe_ids ARRAY<STRING>, cpe_matches ARRAY<STRING>, has_exploit_ref BOOLEAN, "
    "is_kev BOOLEAN, kev_date_added DATE, kev_ransomware_use STRING, kev_required_action STRING, kev_due_date DATE, kev_vendor_project STRING, kev_product STRING, "
    "loaded_to_neo4j BOOLEAN, kev_neo4j_dirty BOOLEAN, ingested_at TIMESTAMP_NTZ"
)
_NVD_OWNED = tuple(c for c in Table("", _CVE, ()).names if c != "cve_id" and c not in _KEV_COLUMNS and c not in ("loaded_to_neo4j", "kev_neo4j_dirty"))

TABLES = {
    t.name: t
    for t in (
        Table("cve_records", _CVE, ("cve_id",), {"nvd": _NVD_OWNED, "kev": _KEV_COLUMNS, "sync": ("loaded_to_neo4j", "kev_neo4j_dirty")}),
        Table("cwe_records", ("cwe_id STRING, name STRING, abstraction STRING, status STRING, description STRING, is_deprecated BOOLEAN, loaded_to_neo4j BOOLEAN"), ("cwe_id",)),
        Table("cve_cwe_mappings", ("mapping_id STRING, cve_id STRING, cwe_id STRING, source STRING"), ("mapping_id",)),
        Table("kev_pending_fetch", ("cve_id STRING, fetched BOOLEAN, kev_date_added DATE, kev_ransomware_use STRING, kev_required_action STRING, kev_due_date DATE, kev_vendor_project STRING, kev_product STRING"), ("cve_id",)),
        Table("attack_techniques", ("mitre_id STRING, stix_id STRING, name STRING, description STRING, tactic STRING, platforms ARRAY<STRING>, is_subtechnique BOOLEAN, parent_id STRING, version STRING"), ("mitre_id",)),
        Table("attack_actors", ("actor_name STRING, stix_id STRING, actor_id STRING, aliases ARRAY<STRING>, description STRING"), ("actor_name",)),
        Table("attack_mitigations", ("mitigation_id STRING, stix_id STRING, name STRING, description STRING"), ("mitigation_id",)),
        Table("attack_tactics", ("tactic_id STRING, stix_id STRING, name STRING, shortname STRING, tactic_order INT"), ("tactic_id",)),
        Table("attack_campaigns", ("campaign_id STRING, stix_id STRING, name STRING, description STRING, first_seen DATE, last_seen DATE"), ("campaign_id",)),
        Table("attack_relationships", ("relationship_id STRING, source_name STRING, target_name STRING, relationship_type STRING"), ("relationship_id",)),
        Table("advisories", ("advisory_id STRING, title STRING, document_type STRING, published_date DATE, co_authors ARRAY<STRING>, threat_actors ARRAY<STRING>, cve_ids_mentioned ARRAY<STRING>, mitre_ids_mentioned ARRAY<STRING>, url STRING"), ("advisory_id",)),
        Table("advisory_chunks", ("chunk_id STRING, advisory_id STRING, chunk_index INT, section_name STRING, sub_section STRING, chunk_text STRING, token_count INT, content_hash STRING, cve_ids ARRAY<STRING>, cwe_ids ARRAY<STRING>, mitre_tech_ids ARRAY<STRING>, chunk_embedding ARRAY<FLOAT>"), ("chunk_id",)),
        Table("demonstration_pool", ("demo_id STRING, advisory_id STRING, text STRING, gold_triplets STRING, embedding ARRAY<FLOAT>"), ("demo_id",)),
        Table("extracted_triplets", ("triplet_id STRING, advisory_id STRING, subject STRING, relation STRING, object STRING"), ("triplet_id",)),
        Table("entity_aliases", ("alias_name STRING, canonical_name STRING, entity_type STRING"), ("alias_name",)),
        Table("pipeline_runs", ("run_id STRING, source STRING, status STRING, started_at TIMESTAMP_NTZ, completed_at TIMESTAMP_NTZ, records_in BIGINT, records_out BIGINT, error STRING, stats STRING"), ("run_id",)),
        Table("ingestion_checkpoints", ("source STRING, last_watermark DATE, updated_at TIMESTAMP_NTZ, notes STRING"), ("source",)),
        Table("llm_usage_log", ("log_id STRING, stage STRING, model STRING, input_tokens BIGINT, output_tokens BIGINT, estimated_cost_usd DECIMAL(14,6), created_at TIMESTAMP"), ("log_id",)),
    )
}


def conform(df: DataFrame, table: Table) -> DataFrame:
    """The table's columns in order and type; missing ones null, others dropped."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.columns])


def evolve(df: DataFrame, added: str) -> DataFrame:
    """Add the columns that are not there yet; running it again changes nothing."""
    have = {c.lower() for c in df.columns}
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in StructType.fromDDL(added) if f.name.lower() not in have})


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    """Keys that a uniqueness constraint would refuse; empty if it holds."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
