"""Predicates shared by searches, digests and loads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Relation as extracted -> relation type in the graph; spelling counts.
RELATIONS = {r: r.upper() for r in sorted("uses targets exploits mitigates affects attributed_to has_weakness".split())}
#: Names that stand for nobody in particular.
VAGUE = sorted(
    {f"{the}{who}" for who in ("attacker", "actor", "threat actor", "malware", "adversary") for the in ("", "the ")} - {"the actor"}
    | {"the actor", "the attackers", "the group"}
    | {f"{kind}actors" for kind in ("malicious ", "malicious cyber ", "threat ", "cyber ", "apt ")}
    | {"apt actor", "attackers"}
)


def overlaps(column: Column, wanted: Sequence[str]) -> Column:
    """Any element is wanted; false, not null, where elements are null."""
    return F.coalesce(F.arrays_overlap(column, F.array(*[F.lit(x) for x in wanted])), F.lit(False))


def metadata(chunks: DataFrame, parents: DataFrame | None = None, *, parent: str = "advisory_id", document_types: Sequence[str] = (), section_names: Sequence[str] = (), ids: Sequence = (), arrays: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Conjunction of the filters that are given; an empty one doesn't filter."""
    if document_types:
        chunks = chunks.join(parents.where(F.col("document_type").isin(*document_types)).select(parent), parent, "left_semi")
    if section_names:
        chunks = chunks.where(F.col("section_name").isin(*section_names))
    if ids:
        chunks = chunks.where(F.col(parent).isin(*ids))
    for column, wanted in (arrays or {}).items():
        if wanted:
            chunks = chunks.where(overlaps(F.col(column), wanted))
    return chunks


def in_window(start: str, end: str, *, changed: str = "last_modified", flag: str = "is_kev", added: str = "kev_date_added") -> Column:
    """Changed in ``[start, end)``, or flagged and added in it."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    return ((F.col(changed) >= first.cast("timestamp_ntz")) & (F.col(changed) < last.cast("timestamp_ntz"))) | added_within(start, end, flag=flag, added=added)


def added_within(start: str, end: str, *, flag: str = "is_kev", added: str = "kev_date_added") -> Column:
    return F.col(flag) & (F.col(added) >= F.lit(start).cast("date")) & (F.col(added) < F.lit(end).cast("date"))


def not_rejected(status: str = "vuln_status", any_case: bool = False) -> Column:
    """Null statuses are dropped, as SQL's ``<>`` does; ``any_case`` also drops other spellings of it."""
    column = F.col(status)
    return (F.upper(column) if any_case else column) != "REJECTED"


def optional_since(column: str, since: str | None) -> Column:
    return F.lit(True) if since is None else F.col(column) >= F.lit(since).cast("timestamp_ntz")


def same_text(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def contains_text(a: Column, b: Column) -> Column:
    return F.contains(F.lower(a), F.lower(b))


def named_entity(column: Column) -> Column:
    """Not an address, not a long hexadecimal string, three letters at least."""
    name = F.trim(column)
    return (F.length(name) >= 3) & ~name.rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$") & ~name.rlike(r"^[0-9a-fA-F]{16,}$")


def vague(column: Column) -> Column:
    return F.lower(F.trim(column)).isin(*VAGUE)
