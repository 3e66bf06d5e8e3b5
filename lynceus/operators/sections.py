"""Advisory pages to sections and chunks.

HTML needs a parser, which is Python on Arrow batches (``mapInArrow``); what
follows (token windows, identifiers, hashes) is expressions again.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lynceus.functions import text as T

HARD_LIMIT = 2500
NOISE = frozenset("aside footer form header nav noscript script style".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SKIPPED = frozenset(
    x.strip()
    for x in "acknowledgment | acknowledgements | contact information | disclaimer | disclaimer of endorsement | document faq | feedback | notes | notification | please share your thoughts | purpose | related advisories | reporting | share your thoughts | tags | version history".split("|")
)


def _keywords(text: str) -> dict[str, tuple[str, ...]]:
    """``name: word, word; name: ...`` in the order in which names are tried."""
    return {name.strip(): tuple(sorted(w.strip() for w in words.split(","))) for name, words in (x.split(":") for x in text.split(";"))}


_SUMMARY = "Summary: summary, overview, introduction, at a glance, executive summary"
_GENERAL = (
    "IoC: ioc, indicators, indicator of compromise, artifact; MITRE: tactics and techniques, mitre, d3fend, att&ck; CVE: cves, cves exploited, vulnerabilities exploited;"
    "Detection: detection, hunting guidance, sigma, threat hunting, validate security, yara; Technical Detail: case study, collection, command and control, credential access, defense evasion, discovery,"
    "exfiltration, impact, initial access, kill chain, lateral, persistence, privilege, reconnaissance, resource development, technical, threat actor activit, ttp;"
    "Lessons: noted strength, lessons learned, key finding; Mitigation: hardening, incident response, mitigation, recommendation; Background: actor profile, background, development of, group profile, historical;"
    "Resource: appendix, resource;"
)
_MALWARE = "Relationship: relationship; Findings: finding; Detection: detection, sigma, yara; MITRE: technique, mitre, att&ck; Recommendation: mitigation, recommend;"
_REPORT = "Malware Metadata: metadata; Malware Delivery: delivery; Malware Functionality: functionality, capabilit; Detection: detection, sigma, yara; MITRE: technique, mitre, att&ck; Mitigation: recommendation, mitigation, incident response; Appendix: appendix;"


@dataclass(frozen=True)
class Strategy:
    """How documents of a type are cut."""

    keywords: dict[str, tuple[str, ...]]
    most: int = 1000
    overlap: int = 150
    main: str = "auto"
    sub: str = "h3"
    protected: frozenset[str] = frozenset()


_LISTS = frozenset({"CVE", "IoC", "MITRE"})
_ADVISORY = _keywords(_GENERAL + _SUMMARY)

STRATEGIES = {
    "CSA": Strategy(_ADVISORY, protected=_LISTS),
    "JOINT_CSA": Strategy(_ADVISORY, main="h2", protected=_LISTS),
    "STOPRANSOMWARE": Strategy(_ADVISORY, main="h2", protected=_LISTS),
    "MAR": Strategy(_keywords(_MALWARE + _SUMMARY), most=1400, overlap=200, main="h3", sub="h4", protected=frozenset({"Findings"})),
    "ANALYSIS_REPORT": Strategy(_keywords(_REPORT + _SUMMARY), most=1200, main="h2", protected=frozenset({"Detection"})),
    "IR_LESSONS": Strategy(_keywords(_GENERAL + _SUMMARY + "; Timeline: timeline, key events"), most=700, overlap=100, main="h2", protected=frozenset({"Lessons", "Timeline"})),
}


@dataclass
class Node:
    tag: str
    children: list = field(default_factory=list)
    attrs: dict = field(default_factory=dict)

    def find(self, tag: str):
        for child in self.children:
            if isinstance(child, Node):
                if child.tag == tag:
                    return child
                if (found := child.find(tag)) is not None:
                    return found
        return None

    def all(self, tag: str) -> list:
        out = []
        for child in self.children:
            if isinstance(child, Node):
                out += [child] * (child.tag == tag) + child.all(tag)
        return out

    def strings(self):
        for child in self.children:
            if isinstance(child, Node):
                yield from child.strings()
            else:
                yield child

    def text(self, separator: str = "") -> str:
        return separator.join(s for s in (x.strip() for x in self.strings()) if s)


class _Tree(HTMLParser):
    """Elements and texts; comments and the document type are left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li", "tr", "td", "option") and self.stack[-1].tag == tag:
            self.stack.pop()
        node = Node(tag, attrs=dict(attrs))
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                del self.stack[k:]
                return

    def handle_data(self, data):
        self.stack[-1].children.append(data)


def parse(html: str | None) -> Node:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


def _without_noise(node: Node) -> Node:
    return Node(node.tag, [c if isinstance(c, str) else _without_noise(c) for c in node.children if isinstance(c, str) or c.tag not in NOISE], node.attrs)


def clean(html: str | None) -> Node:
    """The page without noise; only its ``<main>`` if it has one."""
    root = _without_noise(parse(html))
    return root.find("main") or root


def section_name(heading: str, keywords: dict[str, tuple[str, ...]]) -> str:
    low = heading.lower()
    return next((name for name, words in keywords.items() if any(w in low for w in words)), "General")


def heading_level(main: Node, wanted: str = "auto") -> str:
    if wanted != "auto":
        return wanted
    return "h2" if sum(h.text().lower() not in SKIPPED for h in main.all("h2")) >= 2 else "h3"


def sections(html: str | None, kind: str | None = "CSA") -> list[tuple[str, str | None, str]]:
    """``(section, sub-section, text)`` in reading order.

    Text before the first heading is the summary. A skipped main heading drops
    its text; a skipped sub-heading's text goes to the section's introduction.
    A section's introduction comes before its sub-sections.
    """
    plan = STRATEGIES.get(kind or "", STRATEGIES["CSA"])
    main = clean(html)
    level = heading_level(main, plan.main)
    blocks = [("Summary", [], [])]
    skip, sub = False, None

    def walk(node: Node) -> None:
        nonlocal skip, sub
        for child in node.children:
            if isinstance(child, str):
                if not skip and (text := child.strip()):
                    (blocks[-1][1] if sub is None else sub[1]).append(text)
            elif child.tag == level:
                heading = child.text()
                sub = None
                skip = heading.lower() in SKIPPED
                if not skip:
                    blocks.append((section_name(heading, plan.keywords), [], []))
            elif child.tag == plan.sub and not skip:
                heading = child.text()
                sub = None
                if heading.lower() not in SKIPPED:
                    sub = (heading, [])
                    blocks[-1][2].append(sub)
            else:
                walk(child)

    walk(main)
    out = []
    for name, intro, subs in blocks:
        for heading, parts in ((None, intro), *subs):
            if text := " ".join(parts).strip():
                out.append((name, heading, text))
    return out


def flat_sections(html: str | None) -> list[tuple[str, str]]:
    """The older cut: one level of headings, text before the first is ``General``."""
    main = clean(html)
    level = heading_level(main)
    names = STRATEGIES["CSA"].keywords
    out, name, parts, skip = [], "General", [], False

    def flush() -> None:
        if parts and not skip:
            out.append((name, " ".join(parts).strip()))

    def walk(node: Node) -> None:
        nonlocal name, parts, skip
        for child in node.children:
            if isinstance(child, str):
                if not skip and child.strip():
                    parts.append(child.strip())
            elif child.tag == level:
                flush()
                heading, parts = child.text(), []
                skip = heading.lower() in SKIPPED
                if not skip:
                    name = section_name(heading, names)
            else:
                walk(child)

    walk(main)
    flush()
    return out


PAGES_AT_ONCE = 128


def _small(stream):
    """Batches of few pages: a page is many times its text while it is parsed."""
    for batch in stream:
        for start in range(0, batch.num_rows, PAGES_AT_ONCE):
            yield batch.slice(start, PAGES_AT_ONCE)


def split(pages: DataFrame, *, id_col: str = "advisory_id", html_col: str = "html", type_col: str | None = "document_type") -> DataFrame:
    """``advisory_id, ordinal, section_name, sub_section, text``."""
    narrow = pages.select(F.col(id_col).alias("advisory_id"), F.col(html_col).alias("html"), (F.col(type_col) if type_col else F.lit("CSA")).alias("document_type"))
    kind = narrow.schema["advisory_id"].dataType.simpleString()

    def run(stream):
        for batch in _small(stream):
            rows = [(k, n, *s) for k, (html, t) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())) for n, s in enumerate(sections(html, t))]
            at, n, name, sub, text = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(n, pa.int32()), pa.array(name, pa.string()), pa.array(sub, pa.string()), pa.array(text, pa.string())], names=["advisory_id", "ordinal", "section_name", "sub_section", "text"])

    return narrow.mapInArrow(run, f"advisory_id {kind}, ordinal int, section_name string, sub_section string, text string")


def chunks(pages: DataFrame, *, id_col: str = "advisory_id", html_col: str = "html", type_col: str | None = "document_type") -> DataFrame:
    """Chunk rows of pages: sections in token windows, with ids, hashes and identifiers.

    A protected section stays whole up to the hard limit. The window's text is
    its tokens with the spaces between them.
    """
    cut = split(pages, id_col=id_col, html_col=html_col, type_col=type_col)
    kinds = pages.select(F.col(id_col).alias("advisory_id"), (F.col(type_col) if type_col else F.lit("CSA")).alias("document_type"))
    per_type = [F.struct(F.lit(k).alias("k"), F.lit(s.most).alias("most"), F.lit(s.overlap).alias("overlap"), F.array(*[F.lit(p) for p in sorted(s.protected)]).cast("array<string>").alias("protected")) for k, s in STRATEGIES.items()]
    plans = F.array(*per_type)
    rows = cut.join(kinds, "advisory_id")
    plan = F.coalesce(F.get(F.filter(plans, lambda p: p["k"] == F.col("document_type")), 0), F.get(F.filter(plans, lambda p: p["k"] == "CSA"), 0))
    rows = rows.withColumn("_plan", plan).withColumn("_most", F.when(F.array_contains("_plan.protected", F.col("section_name")), HARD_LIMIT).otherwise(F.col("_plan.most"))).withColumn("_overlap", F.col("_plan.overlap"))
    # a token keeps the space before it, so that a window's text is what was there
    rows = rows.withColumn("_tokens", T.all_matches(F.col("text"), r"\s*(?:[0-9A-Za-z_]+|[^0-9A-Za-z_\s])"))
    step = F.col("_most") - F.col("_overlap")
    count = F.when(F.size("_tokens") <= F.col("_most"), 1).otherwise(F.ceil((F.size("_tokens") - F.col("_overlap")) / step)).cast("int")
    part = F.explode(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("i"), F.slice("_tokens", (i * step + 1).cast("int"), F.col("_most")).alias("t"))))
    rows = rows.select("advisory_id", "ordinal", "section_name", "sub_section", part.alias("w"))
    rows = rows.select("advisory_id", "ordinal", F.col("w.i").alias("_i"), "section_name", "sub_section", F.trim(F.array_join("w.t", "")).alias("chunk_text"), F.size("w.t").alias("token_count")).where("chunk_text <> ''")
    rows = rows.withColumn("chunk_index", F.row_number().over(Window.partitionBy("advisory_id").orderBy("ordinal", "_i")) - 1)
    return rows.select(
        F.concat(F.col("advisory_id").cast("string"), F.lit("_"), F.lpad(F.col("chunk_index").cast("string"), F.lit(3), F.lit("0"))).alias("chunk_id"),
        "advisory_id", "chunk_index", "section_name", "sub_section", "chunk_text", "token_count", T.content_hash(F.col("chunk_text")).alias("content_hash"),
        T.vulnerability_ids(F.col("chunk_text")).alias("cve_ids"), T.weakness_ids(F.col("chunk_text")).alias("cwe_ids"), T.technique_ids(F.col("chunk_text")).alias("mitre_tech_ids"),
    )


def classified(advisories: DataFrame, pages: DataFrame, *, id_col: str = "advisory_id", html_col: str = "html") -> DataFrame:
    """``document_type`` for advisories that have none; the page is looked up only where title and kind don't decide."""
    kind = advisories.schema[id_col].dataType.simpleString()

    def run(stream):
        for batch in _small(stream):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([clean(h).text("\n") for h in batch.column(1).to_pylist()], pa.string())], names=[id_col, "_body"])

    todo = advisories.where("document_type is null")
    blank = T.document_type(F.col("title"), F.col("advisory_type"), F.col("co_authors"), F.lit(""))
    undecided = todo.where(blank == "CSA").select(id_col)
    # of several pages with one id the first in order counts, so that an advisory stays one row
    own = pages.join(undecided, id_col, "left_semi").groupBy(id_col).agg(F.min(html_col).alias(html_col))
    bodies = own.select(id_col, html_col).mapInArrow(run, f"{id_col} {kind}, _body string")
    done = todo.join(bodies, id_col, "left").withColumn("document_type", T.document_type(F.col("title"), F.col("advisory_type"), F.coalesce("co_authors", T.co_authors(F.col("_body"))), F.col("_body"))).drop("_body")
    return advisories.where("document_type is not null").unionByName(done)


def flat(pages: DataFrame, *, id_col: str = "advisory_id", html_col: str = "html") -> DataFrame:
    """``advisory_id, ordinal, section_name, text`` by the older cut."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(stream):
        for batch in _small(stream):
            rows = [(k, n, *s) for k, html in enumerate(batch.column(1).to_pylist()) for n, s in enumerate(flat_sections(html))]
            at, n, name, text = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(n, pa.int32()), pa.array(name, pa.string()), pa.array(text, pa.string())], names=["advisory_id", "ordinal", "section_name", "text"])

    return pages.select(id_col, html_col).mapInArrow(run, f"advisory_id {kind}, ordinal int, section_name string, text string")


def mentions(chunk_rows: DataFrame) -> DataFrame:
    """``advisory_id, cve_ids_mentioned, mitre_ids_mentioned`` of an advisory's chunks, each id once and in order."""
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return chunk_rows.groupBy("advisory_id").agg(every("cve_ids").alias("cve_ids_mentioned"), every("mitre_tech_ids").alias("mitre_ids_mentioned"))
