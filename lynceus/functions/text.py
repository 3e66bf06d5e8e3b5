"""Text expressions: tokens, identifiers, token windows, hashes, document types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STOPWORDS = tuple(
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don down during each few for from further had has have "
    "having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own same she "
    "should so some such than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with you your yours yourself yourselves".split()
)

#: Identifiers that stay whole, in the order in which they are taken out.
ATOMS = (
    r"(?i)CVE-[0-9]{4}-[0-9]{4,}",
    r"(?i)CWE-[0-9]+",
    r"(?i)\bT[0-9]{4}(?:\.[0-9]{3})?\b",
    r"(?i)\b(?:aa[0-9]{2}-[0-9]{3,}[a-z]?|ar[0-9]{2}-[0-9]{3,}[a-z]?|mar-[0-9]+(?:-[0-9]+)?(?:\.v[0-9]+)?)\b",
    r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
)
WORD = "[a-zA-Z0-9]+"

_AGENCIES = r"\b(ACSC|ANSSI|ASD|BSI|CCCS|CERT-NZ|CISA|CSE|DHS|DOE|DoD|EPA|FBI|HHS|JPCERT(?:/CC)?|KISA|MS-ISAC|NCA|NCSC(?:-[A-Z]+)?|NSA|SingCERT|USCG|USSS)\b"


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def tokens(text: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Identifiers first, each kind in turn, then the other words without stop words; all lower case."""
    found = [F.transform(all_matches(text, p), F.lower) for p in ATOMS]
    rest = text
    for p in ATOMS:
        rest = F.regexp_replace(rest, p, " ")

    def words(of: Column) -> Column:
        return F.filter(F.transform(all_matches(of, WORD), F.lower), lambda w: ~w.isin(*stopwords))

    # most texts hold no identifier, and one scan tells
    some = text.rlike("|".join(f"(?:{p})" for p in ATOMS))
    return F.coalesce(F.when(some, F.concat(*found, words(rest))).otherwise(words(text)), F.array().cast("array<string>"))


def _distinct_sorted(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def vulnerability_ids(text: Column) -> Column:
    return _distinct_sorted(F.transform(all_matches(text, r"(?i)CVE-[0-9]{4}-[0-9]{4,7}"), F.upper))


def weakness_ids(text: Column) -> Column:
    return _distinct_sorted(F.transform(all_matches(text, r"(?i)CWE-[0-9]+"), F.upper))


def technique_ids(text: Column) -> Column:
    """Case counts here: ``t1059`` is a word."""
    return _distinct_sorted(all_matches(text, r"\bT[0-9]{4}(?:\.[0-9]{3})?\b"))


def content_hash(text: Column) -> Column:
    return F.sha2(F.trim(text), 256)


def split_tokens(text: Column) -> Column:
    """The default tokeniser of the window splitter: words, and other marks one by one."""
    return all_matches(text, r"[0-9A-Za-z_]+|[^0-9A-Za-z_\s]")


def window_count(n: Column, most: int, overlap: int) -> Column:
    return F.when(n <= most, 1).otherwise(F.ceil((n - overlap) / (most - overlap))).cast("int")


def windows(token_array: Column, most: int, overlap: int) -> Column:
    """``array<struct<idx, tokens>>`` of windows of ``most`` tokens of which neighbours share ``overlap``.

    Give a column that holds the tokens, not the expression that makes them:
    the latter would be computed again for every window.
    """
    if not 0 <= overlap < most:
        raise ValueError("the overlap must be less than the window")
    count = window_count(F.size(token_array), most, overlap)
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("idx"), F.slice(token_array, i * (most - overlap) + 1, F.lit(most)).alias("tokens")))


def document_type(title: Column, kind: Column, co_authors: Column, body: Column) -> Column:
    """The finer type of an advisory: by its title, its co-authors, the agencies that its opening names."""
    t = F.coalesce(title, F.lit(""))
    engagement = "assessment|engagement|operations|shares"
    lessons = rf"(?i)enhancing cyber resilience|incident response engagement|\bir engagement|ir engagement|lessons learned|red team(?:['’]s)?\s+({engagement})|risk and vulnerability assessment"
    agencies = F.size(F.array_distinct(all_matches(F.left(F.coalesce(body, F.lit("")), F.lit(4000)), _AGENCIES, 1)))
    return (
        F.when((kind == "analysis_report") & t.rlike(r"(?i)malware analysis report|\bMAR[-‐-―\s]?[0-9]"), "MAR")
        .when(kind == "analysis_report", "ANALYSIS_REPORT")
        .when(t.rlike(r"(?i)#?\s*stopransomware"), "STOPRANSOMWARE")
        .when(t.rlike(lessons), "IR_LESSONS")
        .when((F.coalesce(F.size(co_authors), F.lit(0)) >= 2) | (agencies >= 2), "JOINT_CSA")
        .otherwise("CSA")
    )


def co_authors(body: Column) -> Column:
    """Organisations of the "co-authored by" passage."""
    passage = F.regexp_extract(body, r"(?is)co[-\s]?authored\s+by[:\s]+(.+?)(?:\n\n|\.\s|\z)", 1)
    parts = F.transform(F.split(passage, r"[,;\n]|\band\b"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: (p != "") & (F.length(p) < 120))


def entity_type(name: Column, classified: Column | None = None) -> Column:
    """By the form of the name, else as classified, else ``other``."""
    text = F.upper(F.trim(name))
    known = F.when(text.rlike(r"^CVE-[0-9]{4}-[0-9]{4,}$"), "cve").when(text.rlike(r"^CWE-[0-9]+$"), "cwe").when(text.rlike(r"^TA[0-9]{4}$"), "tactic").when(text.rlike(r"^T[0-9]{4}(\.[0-9]{3})?$"), "technique")
    if classified is not None:
        known = F.coalesce(known, F.when(classified.isin("actor", "campaign", "cve", "cwe", "other", "software", "tactic", "technique"), classified))
    return F.coalesce(known, F.lit("other"))


NODE_LABELS = {"cve": "CVE", "cwe": "CWE", "actor": "Actor", "software": "Malware", "technique": "Technique", "tactic": "Tactic", "campaign": "Campaign", "other": "Other"}


def node_label(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in NODE_LABELS.items() for x in pair]), kind), F.lit("Other"))


def age(seconds: Column) -> Column:
    """``5s``, ``3m``, ``2h`` or ``4d``."""
    whole = lambda n: F.floor(seconds / n).cast("string")
    return F.when(seconds < 60, F.concat(whole(1), F.lit("s"))).when(seconds < 3600, F.concat(whole(60), F.lit("m"))).when(seconds < 86400, F.concat(whole(3600), F.lit("h"))).otherwise(F.concat(whole(86400), F.lit("d")))


def json_array(text: Column, ddl: str) -> Column:
    """An array from model output, in a code fence or not; null if it isn't one."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[a-z]*\s*", ""), r"\s*```$", "")
    return F.from_json(bare, ddl)


def slash_variants(name: Column) -> Column:
    """``A/B`` to its parts, trimmed, and the whole."""
    return F.array_distinct(F.filter(F.transform(F.concat(F.array(name), F.split(name, "/")), lambda p: F.lower(F.trim(p))), lambda p: p != ""))


DOCUMENT_TYPES = ("CSA", "JOINT_CSA", "STOPRANSOMWARE", "MAR", "ANALYSIS_REPORT", "IR_LESSONS")


def wanted_types(question: Column, chosen: Column | None = None) -> Column:
    """Document types to search for a question, each once and in order; none of them is no filter.

    ``chosen`` is what a classifier said; types that don't exist are dropped.
    Without one the question's words decide.
    """
    if chosen is not None:
        return F.array_sort(F.array_distinct(F.filter(F.coalesce(chosen, F.array().cast("array<string>")), lambda t: t.isin(*DOCUMENT_TYPES))))
    words = (("MAR", r"(?i)malware analysis|\bMAR\b|malware sample"), ("STOPRANSOMWARE", r"(?i)ransomware"), ("ANALYSIS_REPORT", r"(?i)analysis report"), ("IR_LESSONS", r"(?i)lessons? learned|red team"), ("JOINT_CSA", r"(?i)joint advisory"))
    named = F.array(*[F.when(F.coalesce(question, F.lit("")).rlike(p), t) for t, p in words])
    return F.array_sort(F.filter(named, lambda t: t.isNotNull()))


#: Labels of a node that has several, the telling one first.
LABEL_ORDER = ("CVE", "Technique", "CWE", "Tactic", "Actor", "Malware", "Campaign", "Other")


def main_label(labels: Column) -> Column:
    """The first of ``LABEL_ORDER`` that is among the labels, else the first label, else ``Node``."""
    known = F.filter(F.array(*[F.lit(x) for x in LABEL_ORDER]), lambda x: F.array_contains(labels, x))
    return F.coalesce(F.get(known, 0), F.get(labels, 0), F.lit("Node"))


def node_id(labels: Column, ident: Column, name: Column) -> Column:
    """``label:id``; a named thing without an id goes by its name, any other by ``_anon``."""
    label, blank = main_label(labels), lambda c: F.nullif(F.trim(c), F.lit(""))
    own = F.coalesce(blank(ident), F.when(label.isin("Actor", "Other", "Malware", "Campaign"), blank(name)), F.lit("_anon"))
    return F.concat(label, F.lit(":"), own)


def focus(nodes: Column) -> Column:
    """Of a path's nodes (with ``labels``) the first vulnerability, else the first node."""
    return F.coalesce(F.get(F.filter(nodes, lambda n: main_label(n["labels"]) == "CVE"), 0), F.get(nodes, 0))


def json_row(*columns: str) -> Column:
    """Columns as a JSON object, nulls included, dates and times as ISO text."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false", "dateFormat": "yyyy-MM-dd", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ssXXX"})
