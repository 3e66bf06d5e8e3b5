"""Toxicity by a weighted finite-state pattern grammar.

Words are read as symbols of a small alphabet (strong and mild insults, threat
verbs, addressees, intentions, negations, verbs of saying, contrasts, anything
else). Sentences, or lines, are the clauses that are scored; one of more than
``CLAUSE`` words is scored in stretches of that many, so that a text without
marks doesn't add up. The grammar is the composition of five letter-to-letter
transducers:

* reported speech: in the eight words after a verb of saying, up to a contrast,
  insults and threats are only quoted;
* negation: within three words after a negation, insults and threats are void;
* target: an insult within three words after an addressee, or two before one,
  is aimed at somebody;
* threat: an intention, a threat verb and an addressee, each within three words
  of the one before;
* insult: weighs what the others left.

``compose`` builds the product automaton once; weights along its path add up to
the clause's score. A document scores what its best clause does. Where two
clauses or more have a score, it scores at least their sum over all its clauses
in units of ``DENSITY``, up to ``THRESHOLD``, from which on it is toxic. (There
clauses of under ``SHORT`` words on average count as if they had so many.) So it
takes an aimed insult, a threat, two insults in a clause, or insults all over;
neither a lone word convicts, nor two in a book.

The lexicon of strong insults is extended with words learned from labelled
documents (a bounded sample, the ``SAMPLE`` labelled rows whose ids hash
lowest): words that follow at least ``CONTEXTS`` different words in toxic
documents, and of which the smoothed log-odds of being in a toxic document
exceed those of being in a clean one by ``RATE``. Rates don't change with the
number of labels, so a chance occurrence in a clean text costs no word. Copies
of a text don't add contexts.

Only clauses with an insult or a threat verb leave numpy; their symbol strings
are scored once each and remembered.

Cases. Null, empty or wordless text: score 0. Very long text: all clauses
count. Null labels or ids: not learned from. Null ``doc_id`` and repeated rows:
scored like any other. No labels: the given lexicon alone. Empty table: no
rows. Extra columns: ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus.llm import frames, textkernel

THRESHOLD = 1.0
DENSITY = 0.06
CLAUSE = 40
SHORT = 8
SAMPLE = 20_000
CONTEXTS = 4
RATE = 4.0

OTHER, INSULT, MILD, THREAT, YOU, THEY, INTENT, NEGATION, SAYING, CONTRAST = range(10)
AT_YOU, AT_THEM, MILD_AT_YOU, MILD_AT_THEM = range(10, 14)
_READ, _QUOTE = 10, 8

LEXICON = {
    INSULT: "idiot idiots idiotic moron morons moronic imbecile imbeciles scum scumbag worthless pathetic disgusting stupid loser losers dumbass bastard bastards asshole assholes bitch bitches whore slut retard retarded cretin subhuman vermin degenerate dimwit halfwit dipshit fuckwit dummkopf arschloch trottel vollidiot abschaum hurensohn schlampe connard connasse salaud abruti enculé imbécile ordure crétin estúpido estúpida idiota gilipollas cabrón imbécil escoria pendejo",
    MILD: "trash clown clowns garbage fool fools jerk jerks dumb ugly filth filthy crap liar liars coward cowards freak freaks creep pig pigs rat shit damn hate",
    THREAT: "kill murder hurt stab shoot strangle destroy beat burn hunt crush slaughter butcher hang smash töten umbringen schlagen tuer frapper matar golpear",
    YOU: "you your yours yourself youre ur du dich dir euch tu toi te vous ti usted",
    THEY: "he she him her they them their those these everyone everybody ihn sie ihnen lui eux ellos ellas",
    INTENT: "will gonna going ll shall wanna want wants wanted plan plans planning mean means intend intends should must werde werden vais veux voy quiero",
    NEGATION: "not never no isn aren wasn weren don doesn didn won wouldn shouldn cannot cant isnt arent dont doesnt nobody hardly neither nor nicht kein keine nie pas jamais ne nunca jamás",
    SAYING: "said says say saying told tells called calls wrote writes quoted quotes reported reports claimed claims alleged allegedly stated according sagte sagt dit disait dijo dice",
    CONTRAST: "but however yet though still now aber doch mais pero",
}

_BREAK = np.zeros(256, np.int8)
_BREAK[np.frombuffer(b".!?;\n", np.uint8)] = 1

State = tuple
Step = Callable[[State, int], tuple[State, int, float]]


class Transducer:
    """Deterministic letter-to-letter transducer with additive weights."""

    def __init__(self, start: State, step: Step):
        self.start, self.step = start, step


def compose(first: Transducer, second: Transducer) -> Transducer:
    """What ``second`` makes of the output of ``first``; weights add up."""

    def step(state: State, symbol: int) -> tuple[State, int, float]:
        a, middle, u = first.step(state[0], symbol)
        b, out, v = second.step(state[1], middle)
        return (a, b), out, u + v

    return Transducer((first.start, second.start), step)


def _reported(state: State, symbol: int) -> tuple[State, int, float]:
    if symbol == SAYING:
        return (_QUOTE,), OTHER, 0.0
    if symbol == CONTRAST:
        return (0,), OTHER, 0.0
    return (max(0, state[0] - 1),), OTHER if state[0] and symbol in (INSULT, MILD, THREAT) else symbol, 0.0


def _negation(state: State, symbol: int) -> tuple[State, int, float]:
    if symbol == NEGATION:
        return (3,), OTHER, 0.0
    left = (max(0, state[0] - 1),)
    return left, OTHER if state[0] and symbol in (INSULT, MILD, THREAT) else symbol, 0.0


def _target(state: State, symbol: int) -> tuple[State, int, float]:
    whom, aimed, open_ = state  # words left in which an addressee's insult, an insult's addressee may follow
    if symbol in (YOU, THEY):
        return (symbol, 3, 0), symbol, 0.6 if open_ and symbol == YOU else 0.0
    left = max(0, aimed - 1)
    whom = whom if left else OTHER
    if symbol in (INSULT, MILD):
        at_you, at_them = (AT_YOU, AT_THEM) if symbol == INSULT else (MILD_AT_YOU, MILD_AT_THEM)
        return (whom, left, 2), symbol if not aimed else at_you if state[0] == YOU else at_them, 0.0
    return (whom, left, max(0, open_ - 1)), symbol, 0.0


def _threat(state: State, symbol: int) -> tuple[State, int, float]:
    intent, verb = state
    if symbol == INTENT:
        return (3, verb), symbol, 0.0
    if symbol == THREAT and intent:
        return (0, 3), symbol, 0.0
    if symbol in (YOU, THEY) and verb:
        return (0, 0), symbol, 2.0
    return (max(0, intent - 1), max(0, verb - 1)), symbol, 0.0


_WEIGHT = {INSULT: 0.6, AT_YOU: 1.5, AT_THEM: 1.2, MILD: 0.4, MILD_AT_YOU: 1.0, MILD_AT_THEM: 0.6}


def _insult(state: State, symbol: int) -> tuple[State, int, float]:
    return state, symbol, _WEIGHT.get(symbol, 0.0)


PARTS = (Transducer((0,), _reported), Transducer((0,), _negation), Transducer((OTHER, 0, 0), _target), Transducer((0, 0), _threat), Transducer((), _insult))


class Grammar:
    """The composed transducer as tables over all its reachable states."""

    def __init__(self, parts: tuple[Transducer, ...] = PARTS):
        whole = reduce(compose, parts)
        number, todo = {whole.start: 0}, [whole.start]
        self.next: list[list[int]] = []
        self.weight: list[list[float]] = []
        while len(self.next) < len(todo):
            row, weights = [], []
            for symbol in range(_READ):
                state, _, weight = whole.step(todo[len(self.next)], symbol)
                if state not in number:
                    number[state] = len(todo)
                    todo.append(state)
                row.append(number[state])
                weights.append(weight)
            self.next.append(row)
            self.weight.append(weights)
        self.known: dict[bytes, float] = {}

    def score(self, clause: bytes) -> float:
        """Weight of the path that reads the clause's symbols."""
        total = self.known.get(clause)
        if total is None:
            state, total = 0, 0.0
            for symbol in clause:
                total += self.weight[state][symbol]
                state = self.next[state][symbol]
            if len(self.known) < 1 << 16:
                self.known[clause] = total
        return total


class Scorer:
    """Lexicon, given and learned, and the grammar."""

    def __init__(self, learned: list[int] | None = None):
        symbols: dict[int, int] = {int(h): INSULT for h in learned or []}
        for symbol, words in LEXICON.items():
            symbols |= dict.fromkeys(textkernel.hash_words(words.split()).tolist(), symbol)
        self.keys = np.array(sorted(symbols), np.uint64)
        self.symbols = np.array([symbols[k] for k in self.keys.tolist()], np.uint8)
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.grammar: Grammar | None = None

    def read(self, hashes: np.ndarray) -> np.ndarray:
        """The symbol of each word."""
        out = np.zeros(len(hashes), np.uint8)
        maybe = np.flatnonzero(self.sieve[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
        out[maybe] = np.where(self.keys[at] == hashes[maybe], self.symbols[at], OTHER)
        return out

    def scores(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Score, and number of clauses that have one, of every text."""
        if self.grammar is None:
            self.grammar = Grammar()
        best, total, scored, clauses = (np.zeros(len(column)) for _ in range(4))
        for row, raw, offsets in textkernel.slices(column):
            starts, _, hashes, first = textkernel.words(raw, offsets)
            symbols = self.read(hashes)
            trigger = (symbols >= INSULT) & (symbols <= THREAT)
            if not trigger.any():
                continue
            docs = len(offsets) - 1
            doc = np.repeat(np.arange(docs), np.diff(first))
            sentence = np.cumsum(textkernel.classes(raw, _BREAK), dtype=np.int32)[starts] + doc  # grows at breaks and between documents
            place = np.arange(len(symbols))
            fresh = np.ones(len(symbols), bool)
            fresh[1:] = sentence[1:] != sentence[:-1]
            fresh |= (place - np.maximum.accumulate(np.where(fresh, place, 0))) % CLAUSE == 0
            clauses[row : row + docs] = np.minimum(np.bincount(doc[fresh], minlength=docs), -(-np.diff(first) // SHORT))
            clause = np.cumsum(fresh) - 1
            hot = np.zeros(int(clause[-1]) + 1, bool)
            hot[clause[trigger]] = True
            chosen = np.flatnonzero(hot[clause])
            symbols, fresh, doc = symbols[chosen], fresh[chosen], doc[chosen]
            place = np.arange(len(symbols))
            last = np.maximum.accumulate(np.where((symbols != OTHER) | fresh, place, 0))
            near = place - last <= _QUOTE + 1  # longer gaps leave every state as so many words do
            symbols, fresh, doc = symbols[near], fresh[near], doc[near]
            text, at = symbols.tobytes(), np.flatnonzero(fresh)
            for begin, end, d in zip(at.tolist(), [*at[1:].tolist(), len(text)], doc[at].tolist()):
                if score := self.grammar.score(text[begin:end]):
                    best[row + d] = max(best[row + d], score)
                    total[row + d] += score
                    scored[row + d] += 1
        dense = np.where(scored > 1, total / np.maximum(clauses, 1) / DENSITY, 0.0)
        return np.maximum(best, np.minimum(dense, THRESHOLD)), scored.astype(np.int64)


def learn(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, contexts: int = CONTEXTS, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> list[int]:
    """Hashes of the words that tell labelled toxic documents from clean ones."""
    schema = pa.schema([("word", pa.int64()), ("before", pa.int64()), ("toxic", pa.bool_()), ("docs", pa.int64())])
    chosen = frames.pick(labels, id=id_col, y=label_col).where("id is not null and y is not null").orderBy(F.xxhash64("id"), "id", "y").limit(sample)

    def run(stream):
        for batch in frames.batches(stream):
            toxic = batch.column(1).to_numpy(zero_copy_only=False) > 0
            yield pa.RecordBatch.from_pydict({"word": [None, None], "before": [None, None], "toxic": [False, True], "docs": [int((~toxic).sum()), int(toxic.sum())]}, schema=schema)
            for row, raw, offsets in textkernel.slices(batch.column(0)):
                _, _, hashes, first = textkernel.words(raw, offsets)
                doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
                before = np.zeros(len(hashes), np.uint64)
                before[1:] = np.where(doc[1:] == doc[:-1], hashes[:-1], 0)
                bad = toxic[row + doc]
                if len(hashes):
                    _, at = np.unique(textkernel.mix(hashes) ^ before ^ bad, return_index=True)
                    # each word's documents are counted on one of its rows
                    order = np.lexsort((doc, hashes))
                    fresh = np.ones(len(order), bool)
                    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
                    kinds, which = np.unique(hashes[order][fresh], return_inverse=True)
                    docs_of = np.stack([np.bincount(which, bad[order][fresh] == b, len(kinds)) for b in (False, True)])
                    place, mark = np.searchsorted(kinds, hashes[at]), bad[at].astype(np.int64)
                    _, once = np.unique(place * 2 + mark, return_index=True)
                    n = np.zeros(len(at), np.int64)
                    n[once] = docs_of[mark[once], place[once]]
                    yield pa.RecordBatch.from_arrays([pa.array(hashes[at].view(np.int64)), pa.array(before[at].view(np.int64)), pa.array(bad[at]), pa.array(n)], schema=schema)

    # the sample is bounded, so it may be broadcast, and its words collected
    rows = frames.pick(docs, id=id_col, text=text_col).join(F.broadcast(chosen), "id").select("text", F.col("y").cast("int").alias("y"))
    words = [
        tuple(r)
        for r in rows.mapInArrow(run, "word long, before long, toxic boolean, docs long")
        .groupBy("word", "before").agg(F.bool_or("toxic").alias("toxic"), *(F.sum(F.when(F.col("toxic") == b, F.col("docs")).otherwise(0)).alias(n) for n, b in (("bad", True), ("fine", False))))
        .groupBy("word").agg(F.count_if("toxic").alias("contexts"), F.sum("bad").alias("bad"), F.sum("fine").alias("fine"))
        .where((F.col("contexts") >= contexts) | F.col("word").isNull()).select("word", "bad", "fine").orderBy("word").collect()
    ]
    bad, fine = next((w[1:] for w in words if w[0] is None), (0, 0))
    return [w & (2**64 - 1) for w, a, b in words if w is not None and _log_odds(a, bad) - _log_odds(b, fine) >= rate]


def _log_odds(part: int, whole: int) -> float:
    """Of being among ``part`` of ``whole`` documents, a quarter of a document added to either side."""
    return math.log((part + 0.25) / (whole - part + 0.25))


def scores(docs: DataFrame, learned: list[int] | None = None, *, threshold: float = THRESHOLD, only_toxic: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, toxicity, n_clauses, is_toxic``: every document, or the toxic ones."""
    narrow = frames.pick(docs, doc_id=id_col, text=text_col)
    scorer = Scorer(learned)

    def run(stream):
        for batch in frames.batches(stream):
            total, clauses = scorer.scores(batch.column(1))
            toxic = total >= threshold
            rows = np.flatnonzero(toxic) if only_toxic else np.arange(len(toxic))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(total[rows]), pa.array(clauses[rows]), pa.array(toxic[rows])], names=["doc_id", "toxicity", "n_clauses", "is_toxic"])

    return narrow.mapInArrow(run, f"doc_id {frames.ddl(narrow, 'doc_id')}, toxicity double, n_clauses long, is_toxic boolean")
