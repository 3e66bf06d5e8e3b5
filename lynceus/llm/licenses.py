"""License scan by canonical digests.

A text is brought to a canonical form: lower case, lines that only name a
copyright holder dropped, spellings that license texts use alike made equal,
punctuation and white space reduced to single spaces. The SHA-256 digest of the
whole canonical text is joined by hash with the digests of known licenses. The
texts that are looked up are each document and each of its lines, so a
document that consists of a license, and a line that is a license notice, are
both found; a text that only mentions a license is not. Lines that the canonical
form drops are looked up in their plain form, so that such a line can be a known
notice itself ("All rights reserved.").

The canonical form is made on Arrow batches: byte classes by numpy, spellings
by RE2, each only in texts that hold a string which its pattern can't do
without. Only ``(id, scope, digest)`` rows leave Python. The known digests are
constants of this module and of ``licensetable`` (or a table given in its place)
of which the size is checked: up to ``BROADCAST_ROWS`` it is broadcast, a larger
one is joined by a shuffle of digests.

Cases. Null or empty text, and a text with no letters or digits: nothing is
found. Very long text: canonicalised whole. A notice that repeats in a
document: one row. Two licenses with the same canonical text: a row each.
Repeated documents and null ids: reported like any other, equal rows once.
Empty tables: no rows. Extra columns: ignored.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lynceus.llm import frames, licensetable, textkernel

BROADCAST_ROWS = 100_000

#: Pattern and replacement, in order; ``$1`` is the first group.
STEPS: tuple[tuple[str, str], ...] = (
    (r"(?m)^[ \t*#/;-]*(copyright|©|\(c\))[^\n]*([0-9]{4}|\(c\)|©|<[^\n]*>|\[[^\n]*\])[^\n]*$", ""),
    (r"(?m)^[ \t*#/;-]*all rights reserved[. \t\r]*$", ""),
    (r"[^0-9a-z\n\x{80}-\x{10FFFF}]+", " "),
)
SPELLINGS: tuple[tuple[str, str], ...] = (
    (r"\blicenc(e|es|ed|ing)\b", "licens$1"),
    (r"\bsub licens", "sublicens"),
    (r"\bnon commercial", "noncommercial"),
    (r"\borganis(e|ed|ation|ations)\b", "organiz$1"),
    (r"\backnowledgement", "acknowledgment"),
    (r"\b(fav|behavi|hon)our", "$1or"),
    (r"\bwhilst\b", "while"),
    (r"\bhttps\b", "http"),
    (r"\bversion ([0-9])", "v$1"),
)

#: Strings of which a line that one of the first two steps drops holds one.
_DROPS = ("copyright", "©", "(c)", "all rights reserved")
#: For each of ``SPELLINGS``, strings of which a text that it changes holds one.
_NEEDS = (("licenc",), ("sub licens",), ("non commercial",), ("organis",), ("acknowledgement",), ("favour", "behaviour", "honour"), ("whilst",), ("https",), ("version ",))
_DROPPED = "|".join(p.removeprefix("(?m)") for p, _ in STEPS[:2])
#: Letters, digits, line ends and the bytes of longer UTF-8 sequences stay, the rest becomes a space.
_KEPT = np.full(256, 32, np.uint8)
for _low, _high in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100), (0x0A, 0x0B)):
    _KEPT[_low:_high] = np.arange(_low, _high)

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

#: License and one of its texts; a license may have several.
KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT),
    ("MIT", f"MIT License\n{_MIT}"),
    ("MIT", f"The MIT License (MIT)\n{_MIT}"),
    ("ISC", _ISC),
    ("ISC", f"ISC License\n{_ISC}"),
    ("BSD-2-Clause", f"{_BSD_HEAD}\n{_BSD_TAIL}"),
    ("BSD-3-Clause", f"{_BSD_HEAD}\n{_BSD_THIRD}\n{_BSD_TAIL}"),
    ("Zlib", _ZLIB),
    ("Apache-2.0", _APACHE),
    *(("Apache-2.0", x) for x in ("Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0.", "This work is licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0")),
    *(("MIT", x) for x in ("Released under the MIT License.", "Licensed under the MIT License.", "This work is licensed under the MIT License.", "SPDX-License-Identifier: MIT")),
    *(("GPL-3.0", x) for x in ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only")),
    *(("CC-BY-NC-4.0", x) for x in ("Licensed under CC BY-NC 4.0.", "Released under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0")),
    *(("CC-BY-4.0", x) for x in ("Licensed under CC BY 4.0.", "Released under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0")),
    *(("CC-BY-SA-4.0", x) for x in ("Licensed under CC BY-SA 4.0.", "Released under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0")),
    ("proprietary", "All rights reserved."),
)


def _holding(texts: pa.Array, strings: tuple[str, ...]) -> np.ndarray:
    """Rows that hold one of the strings."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    raw = memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]].tobytes()
    ends = (offsets[1:] - offsets[0]).tolist()
    found = set()
    for x in map(str.encode, strings):
        at = raw.find(x)
        while at >= 0:
            row = bisect.bisect_right(ends, at)
            if at + len(x) <= ends[row]:
                found.add(row)
                at = raw.find(x, ends[row])
            else:  # it only seems so where two texts adjoin
                at = raw.find(x, at + 1)
    return np.array(sorted(found), np.int64)


def _without_dropped(texts: pa.Array) -> tuple[pa.Array, dict[int, list[bytes]]]:
    """Small-letter texts with the lines of the first two steps emptied, and those lines by row."""
    rows = _holding(texts, _DROPS)
    lines = pc.split_pattern(texts.take(pa.array(rows)), "\n")
    flat = lines.flatten()
    some = _holding(flat, _DROPS)
    gone = some[pc.match_substring_regex(flat.take(pa.array(some)), _DROPPED).to_numpy(zero_copy_only=False)]
    if not len(gone):
        return texts, {}
    mask = np.zeros(len(flat), bool)
    mask[gone] = True
    starts = lines.offsets.to_numpy()
    out: dict[int, list[bytes]] = {}
    for at, line in zip(rows[np.searchsorted(starts, gone, "right") - 1].tolist(), flat.take(pa.array(gone)).to_pylist()):
        out.setdefault(at, []).append(line.encode())
    emptied = pc.binary_join(pa.ListArray.from_arrays(lines.offsets, pc.if_else(pa.array(mask), "", flat)), "\n")
    return _replaced(texts, rows, emptied), out


def _replaced(texts: pa.Array, rows: np.ndarray, new: pa.Array) -> pa.Array:
    mask = np.zeros(len(texts), bool)
    mask[rows] = True
    return pc.replace_with_mask(texts, pa.array(mask), new)


def bodies(column) -> Iterator[tuple[int, bytes, list[bytes]]]:
    """Row, canonical form with its lines kept apart, and dropped lines of every text but the null ones."""
    valid = textkernel.as_array(column).is_valid().to_numpy(zero_copy_only=False)
    for row, raw, offsets in textkernel.slices(column):
        texts, dropped = _without_dropped(pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw.tobytes())))
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[: len(texts) + 1]
        raw = textkernel.classes(np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: offsets[-1]], _KEPT)
        kept = raw != 32
        kept[1:] |= raw[:-1] != 32
        kept[offsets[:-1][offsets[:-1] < len(raw)]] = True
        total = np.zeros(len(raw) + 1, np.int32)
        np.cumsum(kept, out=total[1:])
        texts = pa.StringArray.from_buffers(len(texts), pa.py_buffer(total[offsets]), pa.py_buffer(raw[kept].tobytes()))
        for (pattern, new), needs in zip(SPELLINGS, _NEEDS):
            rows = _holding(texts, needs)
            if len(rows):
                texts = _replaced(texts, rows, pc.replace_substring_regex(texts.take(pa.array(rows)), pattern, new.replace("$", "\\")))
        for k, body in enumerate(texts.cast(pa.binary()).to_pylist()):
            if valid[row + k]:
                yield row + k, body, dropped.get(k, [])


def plain(text: bytes) -> bytes:
    """A small-letter text in single spaces, with the lines that the canonical form drops."""
    return b" ".join(text.translate(_KEPT.tobytes()).split())


def units(column) -> Iterator[tuple[int, str, bytes]]:
    """``(row, scope, text)`` of all that is looked up, each once."""
    for row, body, dropped in bodies(column):
        lines = [x for x in (line.strip(b" ") for line in body.split(b"\n")) if x]
        whole = b" ".join(lines) or plain(b"\n".join(dropped))
        if whole:
            yield row, "document", whole
        for line in {*lines, *(plain(x) for x in dropped)}:
            if line:
                yield row, "line", line


def canonical(text: str) -> bytes:
    """The whole canonical text; of one that is nothing but lines the form drops, its plain form."""
    return next((unit for _, scope, unit in units(pa.array([text], pa.string())) if scope == "document"), b"")


def known(spark: SparkSession, texts: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """``license_id, digest`` of the known texts."""
    return spark.createDataFrame(sorted({(name, hashlib.sha256(canonical(text)).hexdigest()) for name, text in texts}), "license_id string, digest string")


def shipped(spark: SparkSession) -> DataFrame:
    """``license_id, digest`` of all that this package knows: ``KNOWN`` and ``licensetable``."""
    digests = spark.createDataFrame([(x, digest) for x, _, _, digest in licensetable.DIGESTS], "license_id string, digest string")
    return known(spark, KNOWN + licensetable.NOTICES).union(digests).distinct()


def scan(docs: DataFrame, licenses: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, scope, license_id``: scope is ``document`` or ``line``."""
    licenses = shipped(docs.sparkSession) if licenses is None else frames.pick(licenses, license_id="license_id", digest="digest")
    narrow = frames.pick(docs, doc_id=id_col, text=text_col)

    def run(stream):
        for batch in frames.batches(stream):
            rows, scopes, digests = [], [], []
            for row, scope, unit in units(batch.column(1)):
                rows.append(row)
                scopes.append(scope)
                digests.append(hashlib.sha256(unit).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(scopes, pa.string()), pa.array(digests, pa.binary())], names=["doc_id", "scope", "digest"])

    found = narrow.mapInArrow(run, f"doc_id {frames.ddl(narrow, 'doc_id')}, scope string, digest binary")
    wanted = licenses.select("license_id", F.unhex("digest").alias("digest"))
    small = licenses.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return found.join(F.broadcast(wanted) if small else wanted, "digest").select("doc_id", "scope", "license_id").distinct()


def _oracle() -> str:
    """The canonical form by regular expressions, one after the other."""

    def replaced(value: str, pattern: str, new: str) -> str:
        return "regexp_replace({}, {}, {}, 'g')".format(value, *("'" + x.replace("'", "''") + "'" for x in (pattern, new.replace("$", chr(92)))))

    def body(value: str) -> str:
        return reduce(lambda v, step: replaced(v, *step), STEPS + SPELLINGS, f"lower({value})")

    values = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in row)) for row in KNOWN + licensetable.NOTICES)
    digests = ", ".join(f"('{name}', '{digest}')" for name, _, _, digest in licensetable.DIGESTS)
    squeezed = "trim(regexp_replace({}, '[ \\n]+', ' ', 'g'))".format
    plain = lambda value: squeezed(replaced(f"lower({value})", *STEPS[2]))
    lines = "|".join(p for p, _ in STEPS[:2])
    return f"""
WITH given(license_id, text) AS (VALUES {values}),
form AS (SELECT license_id, {squeezed(body('text'))} AS unit, {plain('text')} AS plain FROM given),
known AS (SELECT license_id, sha256(CASE WHEN unit = '' THEN plain ELSE unit END) AS digest FROM form UNION SELECT * FROM (VALUES {digests})),
body AS (SELECT doc_id, text, {body('text')} AS body FROM documents WHERE text IS NOT NULL),
unit AS (
  SELECT doc_id, 'document' AS scope, CASE WHEN {squeezed('body')} = '' THEN {plain('text')} ELSE {squeezed('body')} END AS unit FROM body
  UNION ALL SELECT doc_id, 'line', trim(unnest(string_split(body, chr(10)))) FROM body
  UNION ALL SELECT doc_id, 'line', {plain('line')} FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{lines}')) AS line FROM body)
)
SELECT DISTINCT doc_id, scope, license_id FROM unit JOIN known ON sha256(unit.unit) = digest WHERE unit.unit <> ''
"""


ORACLE_SQL = _oracle()
