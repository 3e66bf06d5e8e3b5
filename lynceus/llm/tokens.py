"""Token counts by a linear longest-match automaton.

A text is cut into units: runs of letters and digits, runs of other marks, and
runs of white space, where a space directly before a word or mark belongs to
it. Each unit is tokenised greedily, always taking the longest vocabulary
entry. The automaton is the vocabulary's byte trie with failure links: a node's
link leads to where the text that is left goes on once the longest entries at
its beginning are popped, and the number of popped entries is stored with it
(``pops``), as is the number needed to finish there (``ends``). Reading a unit
is linear in its bytes and builds no pieces. Bytes that the vocabulary lacks
count as entries of their own.

The trie is a double array, so numpy moves all distinct units of a run of
documents by one byte at a time; a unit's count is looked up for its repeats,
which are told by their bytes and not by a hash alone.

Cases. Null text: null count. Empty text: 0. Very long texts and very long
units: read to the end. Null ``doc_id`` and repeated rows: counted like any
other. Empty table: no rows. Extra columns: ignored.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lynceus.llm import frames, textkernel

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

_SPACE = np.zeros(256, bool)
_SPACE[np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8)] = True
_CLASS = np.where(_SPACE, 0, np.where(textkernel.WORD_BYTE, 1, 2)).astype(np.int8)


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Entries of a file with a base64 entry and its rank in each line."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


@dataclass
class Automaton:
    """Double array: the child of ``s`` by byte ``b`` is ``t = base[s] + b`` if ``check[t] == s``."""

    base: np.ndarray
    check: np.ndarray
    fail: np.ndarray
    pops: np.ndarray
    ends: np.ndarray
    popped: tuple[np.ndarray, np.ndarray]  # first of each node in a list of popped ids, and that list
    ended: tuple[np.ndarray, np.ndarray]  # the same for the ids that finish a unit

    @classmethod
    def of(cls, vocabulary: Iterable[bytes]) -> Automaton:
        ids = {v: i for i, v in reversed(list(enumerate(vocabulary))) if v}
        for b in range(256):  # bytes that the vocabulary lacks come after it
            ids.setdefault(bytes([b]), len(ids))
        entries = ids
        children: list[dict[int, int]] = [{}]
        final = [-1]
        for entry in sorted(entries):
            node = 0
            for byte in entry:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    final.append(-1)
                node = children[node][byte]
            final[node] = ids[entry]
        n = len(children)
        fail, pops, ends = [0] * n, [0] * n, [0] * n
        pop_ids: list[tuple[int, ...]] = [()] * n
        end_ids: list[tuple[int, ...]] = [()] * n
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for byte, node in children[parent].items():
                queue.append(node)
                if final[node] >= 0:
                    fail[node], pop_ids[node] = 0, (final[node],)
                else:
                    at, popped = fail[parent], pop_ids[parent]
                    while byte not in children[at]:  # the root has every byte
                        at, popped = fail[at], popped + pop_ids[at]
                    fail[node], pop_ids[node] = children[at][byte], popped
                end_ids[node] = pop_ids[node] + end_ids[fail[node]]
                pops[node], ends[node] = len(pop_ids[node]), len(end_ids[node])
        slot, base, cells = [0] * n, [0] * n, bytearray(8 * n + 4096)
        taken = np.frombuffer(cells, bool)
        taken[0] = True
        low, gap = 257, 1  # where several children, and where a single one, may find room
        for node in sorted((k for k in range(n) if children[k]), key=lambda k: (k != 0, -len(children[k]))):
            wanted = sorted(children[node])
            if len(wanted) == 1:
                gap = cells.find(0, max(gap, wanted[0] + 1) if gap < 257 else gap)
                start = gap - wanted[0]
            else:
                shape = np.array(wanted) - wanted[0]
                while True:
                    open_ = low + np.flatnonzero(~taken[low : low + 512])
                    fits = open_[~taken[open_[:, None] + shape].any(axis=1)]
                    if len(fits):
                        break
                    low += 512
                start = int(fits[0]) - wanted[0]
            base[node] = start
            for b in wanted:
                cells[start + b] = 1
                slot[children[node][b]] = start + b
        size = max(slot) + 257
        arrays = [np.zeros(size, np.int32) for _ in range(5)]
        where = np.array(slot)
        arrays[1][:] = -1
        parent_slot = np.zeros(n, np.int64)
        for node in range(n):
            for child in children[node].values():
                parent_slot[child] = slot[node]
        arrays[0][where] = base
        arrays[1][where[1:]] = parent_slot[1:]
        arrays[2][where] = where[fail]
        arrays[3][where] = pops
        arrays[4][where] = ends
        lists = []
        for of_node in (pop_ids, end_ids):
            at, flat = np.zeros(size, np.int32), []
            for node, own in enumerate(of_node):
                at[slot[node]] = len(flat)
                flat.extend(own)
            lists.append((at, np.array(flat, np.int32)))
        return cls(*arrays, *lists)

    def count(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seen: list | None = None) -> np.ndarray:
        """Greedy token count of every span of ``raw``.

        ``seen`` gets, in the order of reading, the spans that popped entries
        and the nodes that they left by their failure links.
        """
        order = np.argsort(starts - ends, kind="stable")  # longest first
        begin, length = starts[order], (ends - starts)[order]
        state, total = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        falling = -length
        step, longest = 0, int(length[0]) if len(length) else 0
        while step < longest:
            live = int(np.searchsorted(falling, -step))
            if live <= 8:
                break
            at, byte = state[:live], raw[begin[:live] + step]
            to = self.base[at] + byte
            stuck = np.flatnonzero(self.check[to] != at)
            moved = to.astype(np.int64)
            while len(stuck):
                s = at[stuck]
                total[stuck] += self.pops[s]
                if seen is not None:
                    seen.append((order[stuck], s))
                at[stuck] = s = self.fail[s].astype(np.int64)
                t = self.base[s] + byte[stuck]
                moved[stuck] = t
                stuck = stuck[self.check[t] != s]
            state[:live] = moved
            step += 1
        if step < longest:  # a few very long units: one after the other
            base, check, fail, pops = self.base, self.check, self.fail, self.pops
            for k in range(int(np.searchsorted(falling, -step))):
                s, n = int(state[k]), int(total[k])
                for byte in raw[begin[k] + step : begin[k] + length[k]].tolist():
                    while check[base[s] + byte] != s:
                        n += int(pops[s])
                        if seen is not None:
                            seen.append((order[k : k + 1], np.array([s])))
                        s = int(fail[s])
                    s = int(base[s]) + byte
                state[k], total[k] = s, n
        out = np.empty(len(order), np.int64)
        out[order] = total + self.ends[state]
        if seen is not None:
            seen.append((order, state))
        return out

    def pieces(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the greedy pieces of all spans, and where each span's begin."""
        seen: list = []
        count = self.count(raw, starts, ends, seen)
        spans, nodes = np.concatenate([x for x, _ in seen]), np.concatenate([x for _, x in seen])
        last = np.zeros(len(spans), bool)
        last[len(spans) - len(starts) :] = True
        order = np.argsort(spans, kind="stable")
        nodes, last = nodes[order], last[order]
        size = np.where(last, self.ends[nodes], self.pops[nodes])
        # one list after the other, so that both are read by one index
        begin = np.where(last, self.ended[0][nodes] + len(self.popped[1]), self.popped[0][nodes])
        flat = np.concatenate([self.popped[1], self.ended[1]])
        return flat[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)], np.concatenate([[0], np.cumsum(count)])

    def encode_texts(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin."""
        ids, sizes = [np.zeros(0, np.int32)], []
        for _, raw, offsets in textkernel.slices(column, lower=False):
            starts, ends, doc = units(raw, offsets)
            if not len(starts):
                sizes.append(np.zeros(len(offsets) - 1, np.int64))
                continue
            first, which = textkernel.distinct(raw, starts, ends)
            flat, at = self.pieces(raw, starts[first], ends[first])
            size = np.diff(at)[which]
            ids.append(flat[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(at[which], size)])
            sizes.append(np.bincount(doc, size, len(offsets) - 1).astype(np.int64))
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1, np.int64)

    def count_texts(self, column) -> np.ndarray:
        """Token count of every text; 0 for a null one."""
        out = np.zeros(len(column), np.int64)
        for row, raw, offsets in textkernel.slices(column, lower=False):
            starts, ends, doc = units(raw, offsets)
            if not len(starts):
                continue
            first, which = textkernel.distinct(raw, starts, ends)
            per_unit = self.count(raw, starts[first], ends[first])
            out[row : row + len(offsets) - 1] = np.bincount(doc, per_unit[which], len(offsets) - 1).astype(np.int64)
        return out


def units(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the units of a run of documents."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = textkernel.classes(raw, _CLASS)
    change = np.ones(len(raw), bool)
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change[offsets[:-1][offsets[:-1] < len(raw)]] = True
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], len(raw))
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
    blank = kind[starts] == 0
    lend = np.flatnonzero(blank[:-1] & ~blank[1:])
    lend = lend[(doc[lend + 1] == doc[lend]) & (raw[ends[lend] - 1] == 32)]
    starts[lend + 1] -= 1
    ends[lend] -= 1
    some = ends > starts
    return starts[some], ends[some], doc[some]


def counts(docs: DataFrame, *, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens`` for every row of ``docs``."""
    narrow = frames.pick(docs, doc_id=id_col, text=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(Automaton.of(read_vocabulary(vocabulary)))  # as large as the vocabulary

    def run(stream):
        for batch in frames.batches(stream):
            n = shared.value.count_texts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, mask=np.asarray(batch.column(1).is_null()))], names=["doc_id", "n_tokens"])

    return narrow.mapInArrow(run, f"doc_id {frames.ddl(narrow, 'doc_id')}, n_tokens long")
