"""Operator 6, license scans by conditional compression.

Candidate blocks are the lines around cue words and at least REACH characters, merged over small gaps and cut into overlapping pieces of at most
PIECE characters. Every block is compressed with each template as raw-content Zstandard dictionary, and the templates are ranked by how much
smaller it gets. In that order they are confirmed or refuted by their exact wording: the words of the template are aligned with the block's, and
confirmed if at most one word in ten differs and no word with a digit (a version) or acronym part is missing. Where one confirmed wording
stands within another's place (a GPL header reads like an LGPL one with a word less), the wider place is compressed with both, and the inner one
goes if the other template makes it smaller. A small reduction alone refutes nothing, so no license is lost among many in a block.

``<...>`` in a template stands for up to FEW words. SPDX tags are read as such: every license of the expression, known or not (kind ``tag``).

Defined cases: a null or empty text has no candidates; a text may hold several licenses, each found once; equal rows get equal results; an
empty table gives an empty result; a very long line is searched around each cue; only the columns ``carry`` and the text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import Match, SequenceMatcher
from itertools import pairwise

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.license_texts import TEMPLATES
from skyloom.llm.textops import slices
from skyloom.shipping import ship

CUES = r"licen[cs]e|copyright|rights reserved|permission (?:is hereby|to use)|redistribution|warranty|creative commons|cc[ -]?by|cc0|public domain|free software|mozilla public|spdx"
LINE, GAP, PIECE, OVERLAP = 2000, 200, 16_000, 4_000
#: A block reaches at least this far around a cue: one and a half times the longest template.
REACH = max(len(text) for _, _, text in TEMPLATES) * 3 // 2
#: DIFFER: the share of a template's words that may differ; FEW: the most words that <...> stands for.
DIFFER, FEW = 0.1, 8
FOUND = "array<struct<license:string,kind:string,saved:double,template_words:int,missing:int,extra:int,start:int,stop:int>>"
_WORD = re.compile(r"[^\W_]+(?:[.][0-9]+)*")
_ID = r"\(*[A-Za-z0-9][\w.+-]*\)*"
TAG = re.compile(rf"SPDX-License-Identifier:[ \t]*({_ID}(?:[ \t]+(?:AND|OR|WITH)[ \t]+{_ID})*)", re.IGNORECASE)


_SPDX = {spdx.lower(): spdx for spdx, _, _ in TEMPLATES}


def words(text: str) -> tuple[list[str], list[int]]:
    found = list(_WORD.finditer(text))
    return [m.group().lower().replace("licence", "license") for m in found], [m.start() for m in found]


def tagged(text: str) -> Iterator[tuple[str, int, int]]:
    """(license, start, stop) of the licenses in SPDX tags; exceptions after WITH are none."""
    for m in TAG.finditer(text):
        before = ""
        for part in re.finditer(r"[A-Za-z0-9][\w.+-]*", m.group(1)):
            name = part.group().rstrip(".")
            if name.upper() in ("AND", "OR", "WITH"):
                before = name.upper()
                continue
            if before != "WITH" and name.upper() not in ("NONE", "NOASSERTION"):
                bare = re.sub(r"(?i)-only$|-or-later$|\+$", "", name)
                yield _SPDX.get(bare.lower(), bare), m.start(1) + part.start(), m.start(1) + part.start() + len(name)


def _run(wild: set[int], i: int, n: int) -> int:
    """How many words of a template follow one another from i on."""
    return min((w for w in wild if w > i), default=n) - i


def places(block: list[str]) -> dict[str, list[int]]:
    """Where each word stands."""
    at: dict[str, list[int]] = {}
    for i, w in enumerate(block):
        at.setdefault(w, []).append(i)
    return at


def blocks(text: str, cue: re.Pattern) -> list[tuple[int, int]]:
    """Where candidate blocks begin and end."""
    out: list[list[int]] = []
    for m in cue.finditer(text):
        a = text.rfind("\n", max(0, m.start() - LINE), m.start()) + 1 or max(0, m.start() - LINE)
        b = text.find("\n", m.end(), m.end() + LINE)
        b = min(len(text), m.end() + LINE) if b < 0 else b
        a, b = min(a, max(0, m.start() - REACH)), max(b, min(len(text), m.end() + REACH))
        while a and text[a - 1].isalnum() and a > m.start() - 2 * LINE:
            a -= 1
        while b < len(text) and text[b].isalnum() and b < m.end() + 2 * LINE:
            b += 1
        if out and a <= out[-1][1] + GAP:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(x, min(x + PIECE, b)) for a, b in out for x in range(a, max(a + 1, b - OVERLAP), PIECE - OVERLAP)]


class Templates:
    def __init__(self, templates: list[tuple[str, str, str]] = TEMPLATES):
        self.templates = [(spdx, kind, words(text)[0]) for spdx, kind, text in templates]
        #: before which of a template's words <...> stands
        self.wild = [{len(words("".join(cut[: i + 1]))[0]) for i in range(len(cut) - 1)} for cut in (text.split("<...>") for _, _, text in templates)]
        params = zstandard.ZstdCompressionParameters.from_level(3, min_match=3, write_content_size=0)
        self.alone = zstandard.ZstdCompressor(compression_params=params)
        self.given = [zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, _, w in self.templates]

    def reductions(self, data: bytes) -> list[float]:
        """The share of a block's compressed size that each template saves."""
        plain = len(self.alone.compress(data))
        return [1 - len(c.compress(data)) / plain for c in self.given]

    def contested(self, x: tuple, y: tuple, text: str) -> bool:
        """Whether y takes x's place, which is within y's: by the compressed size of y's place, then by differences."""
        (_, _, _, size, missing, extra, start, stop, k), (_, _, _, size2, missing2, extra2, start2, stop2, k2) = x, y
        if not (start2 <= start and stop <= stop2):
            return False
        data = " ".join(words(text[start2:stop2])[0]).encode()
        cost = lambda j, differ: (len(self.given[j].compress(data)), differ)
        own, other = cost(k, missing + extra), cost(k2, missing2 + extra2)
        return other < own or other == own and (size2, k) > (size, k2)

    @staticmethod
    def aligned(own: list[str], wild: set[int], block: list[str]) -> list[Match]:
        """Equal runs of the template and the block. A short template is looked for word by word, since the nearest word after <...> counts."""
        n = len(own)
        if not wild or n > 12:
            return SequenceMatcher(None, own, block, autojunk=False).get_matching_blocks()
        best: list[Match] = []
        for start in (i for i, w in enumerate(block) if w == own[0]):
            out, at = [Match(0, start, 1)], start + 1
            for i in range(1, n):
                to = next((j for j in range(at, min(len(block), at + 1 + FEW * (i in wild))) if block[j : j + _run(wild, i, n)] == own[i : i + _run(wild, i, n)]), None) if i in wild else at if at < len(block) and block[at] == own[i] else None
                if to is None:
                    break
                out.append(Match(i, to, 1))
                at = to + 1
            else:
                if not best or at - start < best[-1].b + 1 - best[0].b:
                    best = out
        return best

    def compare(self, block: list[str], k: int, at: dict[str, list[int]] | None = None) -> Iterator[tuple[int, int, int, int]]:
        """Places (first word, last word, missing, extra) of a template's wording: words that it has and the block lacks, and the reverse."""
        own, wild = self.templates[k][2], self.wild[k]
        n, more = len(own), FEW * len(self.wild[k])
        at = places(block) if at is None else at
        here = sorted((i for i in range(n) if own[i] in at), key=lambda i: len(at[own[i]]))
        spare = int(DIFFER * n) - (n - len(here))
        if spare < 0:
            return
        # one of spare + 1 words at least stands where the wording does
        for lo in sorted({max(0, place - i - n // 8 - FEW * sum(w <= i for w in wild)) for i in here[: spare + 1] for place in at[own[i]]}):
            hi = min(len(block), lo + n + 2 * (n // 8) + 2 * more)
            parts = [b for b in self.aligned(own, wild, block[lo:hi]) if b.size]
            if not parts:
                continue
            matched = sum(b.size for b in parts)
            few = sum(min(FEW, y.b - x.b - x.size) for x, y in pairwise(parts) if any(x.a + x.size <= w <= y.a for w in wild))
            span = parts[-1].b + parts[-1].size - parts[0].b - few
            lacking = set(range(n)) - {i for b in parts for i in range(b.a, b.a + b.size)}
            if any(re.search(r"\d", own[i]) or len(own[i]) <= 3 and n <= 12 for i in lacking):
                continue
            if (n - matched) + (span - matched) <= DIFFER * n:
                yield lo + parts[0].b, lo + parts[-1].b + parts[-1].size - 1, n - matched, span - matched

    def scan(self, text: str, cue: re.Pattern) -> tuple[int, list[tuple]]:
        found: dict[tuple[str, str], tuple] = {}
        spans = blocks(text, cue)
        for name, start, stop in tagged(text):
            found.setdefault((name, "tag"), (name, "tag", 0.0, 1, 0, 0, start, stop))
        for a, b in spans:
            block, starts = words(text[a:b])
            if not block:
                continue
            at = places(block)
            saved = self.reductions(" ".join(block).encode())
            for k in sorted(range(len(saved)), key=lambda k: -saved[k]):
                spdx, kind, own = self.templates[k]
                for start, end, missing, extra in self.compare(block, k, at):
                    new = (spdx, kind, round(saved[k], 6), len(own), missing, extra, a + starts[start], a + starts[end] + len(block[end]), k)
                    old = found.get((spdx, kind))
                    if old is None or (missing + extra, a + starts[start]) < (old[4] + old[5], old[6]):
                        found[spdx, kind] = new
        tags = [x for x in found.values() if x[1] == "tag"]
        worded = [x for x in found.values() if x[1] != "tag"]
        whole = tags + [x[:-1] for x in worded if not any(y is not x and self.contested(x, y, text) for y in worded)]
        return len(spans), sorted(whole, key=lambda x: (x[6], x[0], x[1]))


_LOADED: list[tuple[Templates, re.Pattern]] = []


def scanned(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry``, n_blocks and matches: licenses with what they save, their wording's differences and where they start."""
    ship(docs.sparkSession)
    few = docs.select(*(f"`{c}`" for c in carry), docs[f"`{text}`"].alias("_text"))
    k = len(carry)
    fields = ("license", "kind", "saved", "template_words", "missing", "extra", "start", "stop")
    kind = pa.list_(pa.struct(list(zip(fields, (pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32()), strict=True))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _LOADED:
            _LOADED.append((Templates(), re.compile(CUES, re.IGNORECASE)))
        templates, cue = _LOADED[0]
        for whole in batches:
            for batch in slices(whole, "_text"):
                column = batch.column(k)
                likely = pc.fill_null(pc.match_substring_regex(column, CUES, ignore_case=True), False).to_pylist()
                n, out = [], []
                for i, maybe in enumerate(likely):
                    blocks_, found = templates.scan(column[i].as_py(), cue) if maybe else (0, [])
                    n.append(blocks_)
                    out.append([dict(zip(fields, x, strict=True)) for x in found])
                yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(n, pa.int64()), pa.array(out, kind)], names=[*carry, "n_blocks", "matches"])

    return few.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in few.schema[:k]] + ["n_blocks long", f"matches {FOUND}"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_blocks", F.array_join(F.array_sort(F.array_distinct("matches.license")), ",").alias("licenses"), F.size("matches").cast("long").alias("n_matches"))
