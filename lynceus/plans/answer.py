"""Questions: routing, pattern choice, evidence and briefs.

What a language model would do is behind small functions that are passed in;
without them a deterministic rule answers, so everything runs offline.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus.operators import digest, graph, merge, search, sections
from lynceus.sources import feeds

_GRAPH = re.compile(r"\b(exploits?|uses?|targets?|related|linked|connected|path|neighbou?rs?|how many|count|which actors?|CVE-[0-9]{4}-[0-9]+|T[0-9]{4})\b", re.I)
_TEXT = re.compile(r"\b(explain|describe|mitigat\w*|recommend\w*|detect\w*|summar\w*|guidance|why|how (do|does|can|should))\b", re.I)
_PATTERNS = (("uses_or_exploits", r"\buse\w*\b.*\bexploit|\bexploit\w*\b.*\buse"), ("exploited", r"known exploited|\bkev\b"), ("exploits", r"\bexploit"), ("targets", r"\btarget"), ("uses", r"\buse"))


@dataclass(frozen=True)
class Decision:
    route: str
    reasoning: str


def route(question: str, classify: Callable[[str], str] | None = None) -> Decision:
    """``graph``, ``text`` or ``both``; anything that fails or isn't one of these is ``both``."""
    try:
        if classify is not None:
            chosen = classify(question)
            return Decision(chosen, "classified") if chosen in ("graph", "text", "both") else Decision("both", "unusable answer")
    except Exception as error:  # a classifier's failure must not stop the answer
        return Decision("both", f"classifier failed: {error}")
    wants_graph, wants_text = bool(_GRAPH.search(question)), bool(_TEXT.search(question))
    if wants_graph != wants_text:
        return Decision("graph" if wants_graph else "text", "by its words")
    return Decision("both", "by its words")


def relevant(question: str, judge: Callable[[str], bool] | None = None) -> bool:
    """Whether to answer at all; yes if the judge fails."""
    try:
        return True if judge is None else bool(judge(question))
    except Exception:  # fails open
        return True


def pattern(question: str, ask: Callable[[str, str | None], str] | None = None, attempts: int = 3) -> str | None:
    """The graph pattern for a question. A chooser gets its last answer's error back, up to ``attempts`` times."""
    names = [n for n, _ in _PATTERNS]
    if ask is not None:
        error = None
        for _ in range(attempts):
            name = ask(question, error)
            if name in names:
                return name
            error = f"there is no pattern {name}"
        return None
    return next((n for n, words in _PATTERNS if re.search(words, question, re.I)), None)


def mentioned_advisories(rows: DataFrame, most: int = 20) -> DataFrame:
    """The first ``most`` advisory ids of a graph answer, sorted."""
    return rows.where("advisory_id is not null").select("advisory_id").distinct().orderBy("advisory_id").limit(most)


def scoped_search(index: search.Index, queries: DataFrame, chunks: DataFrame, advisories: DataFrame, vectors: DataFrame, **options) -> DataFrame:
    """Hybrid search among the chunks of given advisories."""
    allowed = chunks.join(advisories, "advisory_id", "left_semi").select("chunk_id")
    lexical = search.bm25(index, queries)
    near = search.nearest(queries.select("query_id", "vector"), vectors.join(allowed, "chunk_id", "left_semi"), 50, id_col="chunk_id", vector_col="vector")
    return search.hybrid(lexical, near, allowed, **options)


def answer(question: str, nodes: DataFrame, edges: DataFrame, find_text: Callable[[str], DataFrame], *, force: str | None = None, fallback: bool = True, classify=None, judge=None) -> dict:
    """Evidence for a question: the route taken, graph rows and text rows. A graph answer without rows falls back to text."""
    if not relevant(question, judge):
        return {"route": "rejected", "graph": None, "text": None}
    chosen = force or route(question, classify).route
    rows = None
    if chosen in ("graph", "both"):
        name = pattern(question)
        rows = graph.template(edges, nodes, name) if name else None
        if chosen == "graph" and fallback and (rows is None or rows.isEmpty()):
            return {"route": "text", "graph": None, "text": find_text(question)}
    return {"route": chosen, "graph": rows, "text": find_text(question) if chosen in ("text", "both") else None}


def questions(items: DataFrame) -> DataFrame:
    """A question for each digest row."""
    return items.select("cve_id", F.format_string("How is %s exploited, what does it affect, and how is it mitigated? (tier %d)", F.col("cve_id"), F.col("tier")).alias("question"))


def evidence_blocks(items: DataFrame, hits: DataFrame, most: int = 3) -> DataFrame:
    """``cve_id, block``: a digest row and its best passages as text. ``hits``: ``cve_id, rank, chunk_text``."""
    best = F.array_sort(F.collect_list(F.struct("rank", "chunk_text")))
    texts = hits.where(F.col("rank") <= most).groupBy("cve_id").agg(F.array_join(F.transform(best, lambda r: F.concat(F.lit("- "), r["chunk_text"])), "\n").alias("passages"))
    head = F.format_string("%s (tier %d: %s)", F.col("cve_id"), F.col("tier"), F.col("tier_reason"))
    return items.join(texts, "cve_id", "left").select("cve_id", "tier", F.concat_ws("\n", head, F.coalesce("passages", F.lit("- no passages"))).alias("block"))


def brief(blocks: DataFrame, write: Callable[[list[str]], str] | None = None) -> str:
    """The brief's text from its few blocks, in order of tier and id."""
    texts = [r["block"] for r in blocks.orderBy("tier", "cve_id").select("block").collect()]  # as many as the digest's limit
    return write(texts) if write else "\n\n".join(texts)


def weekly_brief(cves: DataFrame, start: str, end: str, find: Callable[[DataFrame], DataFrame], write: Callable[[list[str]], str] | None = None, *, limit: int = 10, most: int = 3) -> tuple[DataFrame, str]:
    """The window's digest with its evidence, and the text that is written of it.

    ``find`` gets the questions of all rows (``cve_id, question``) at once and
    gives ``cve_id, rank, chunk_text``; ``write`` makes prose of the blocks.
    """
    items = digest.with_reason(digest.brief_items(digest.top(cves, start, end, limit=limit), digest.newly_added(cves, start, end)).select("cve_id", "tier"))
    blocks = evidence_blocks(items, find(questions(items)), most)
    return blocks, brief(blocks, write)


def advisory_pipeline(list_pages: DataFrame, pages: DataFrame, advisories: DataFrame, index_path: str, *, site: str, embed: Callable[[list], list], since=None) -> dict[str, DataFrame]:
    """New advisories from list pages to a search index, each step on what the one before made.

    Teasers that aren't known are fetched (``pages``: ``advisory_id, html``),
    classified, cut into chunks, embedded and indexed. Advisories whose page is
    missing stay without chunks. Gives the new ``advisories`` and ``chunks``;
    the index is at ``index_path``.
    """
    found = feeds.to_fetch(feeds.listings(list_pages, site), advisories, since)
    none = F.lit(None).cast("array<string>")
    fresh = found.select("advisory_id", "title", "url", "published_date", "advisory_type", none.alias("co_authors"), F.lit(None).cast("string").alias("document_type"))
    typed = sections.classified(fresh, pages)
    own = pages.join(typed.select("advisory_id", "document_type"), "advisory_id")
    chunk_rows = sections.chunks(own).withColumn("chunk_embedding", F.lit(None).cast("array<float>"))
    embedded = search.missing_vectors(chunk_rows, embed)
    noted = merge.backfill(typed.withColumns({c: none for c in ("cve_ids_mentioned", "mitre_ids_mentioned")}), sections.mentions(chunk_rows), ["advisory_id"], ["cve_ids_mentioned", "mitre_ids_mentioned"])
    search.build(embedded, "chunk_id", "chunk_text", index_path)
    return {"advisories": noted, "chunks": embedded}


def events(items: list[str], text: str, step: int = 80):
    """What a client is sent: ``meta``, ``cves``, the text in parts, ``done``."""
    yield "meta", {"count": len(items)}
    yield "cves", items
    for k in range(0, len(text), step):
        yield "markdown", text[k : k + step]
    yield "done", {}
