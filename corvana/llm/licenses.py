"""License scan by conditional compression.

A text with a cue is searched for the words by which each template may begin (`anchor`); the words around each hit, as far as
the template may reach, are a candidate block, whatever lines they stand on. The block's best-aligned span with the template
is compressed alone and with the template as zstandard raw dictionary. Candidates are ranked by the bytes this saves, must
save `LEAST_GAIN` of their size, and are confirmed by exact wording: `LEAST_AGREED` of the words of the span agree with the
template in order, those which the license needs among them. Every confirmed template is named, but those whose telling words
agree with one that saves more. SPDX lines name their license themselves. "All rights reserved" is a license of its own only in a text
that has no other.

Templates are whole texts of the short licenses, and the notices that name the longer ones (`license_texts`).

Defined results: null and empty texts have no license. Texts without a cue are never compressed. Ties of savings go to the
larger agreement, then to the name. Repeated rows each give their row. Blocks of any length are taken whole, in overlapping parts
that hold any span. An empty table gives an empty result. `licenses`, `n_blocks` and `best_gain` of the input are replaced;
other columns pass through.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .license_texts import SPDX, TEMPLATES

CUES = r"(?i)licen[sc]|copyright|all rights reserved|public domain|permission is hereby|redistribution and use|warranty|creative commons|\bcc[ -]by|\bspdx"
LEAST_GAIN, LEAST_AGREED = 0.2, 0.6
#: Words of a span that must agree (fewer are no notice), and what a skipped word of the template costs against one that agrees.
LEAST_SPAN, SKIPPED = 3, 0.2
#: Words of a notice, at the most: as far as a block goes to each side of a hit, if the template is no longer.
NOTICE = 40
WORD = re.compile(r"[\w.+-]*\w")
SPDX_LINE = re.compile(r"spdx-license-identifier:\s*\(?([\w.+-]*\w)((?:\s+(?:or|and)\s+[\w.+-]*\w)*)")
VERSION = re.compile(r"\b[1-4]\.0\b")


class Scanner:
    """Templates as raw dictionaries; one for each worker."""

    def __init__(self):
        raw = lambda t: zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.alone = zstandard.ZstdCompressor(level=9).compress
        self.given = [zstandard.ZstdCompressor(level=9, dict_data=raw(t.text.lower())).compress for t in TEMPLATES]
        self.words = [WORD.findall(t.text.lower()) for t in TEMPLATES]
        self.anchors = [re.compile(t.anchor) for t in TEMPLATES]
        # The notices of a template repeat one sentence: a block needs to reach no further than the longest text.
        self.reach = [max(NOTICE, int(len(w) / LEAST_AGREED)) if len(w) > 4 * NOTICE else NOTICE for w in self.words]

    def agreement(self, own: list[str], k: int) -> tuple[int, int, list[int]] | None:
        """(first, end, places of words that agree) of the span of own that is best aligned with template k."""
        match = difflib.SequenceMatcher(None, self.words[k], own, autojunk=False).get_matching_blocks()
        pairs = [(m.a + x, m.b + x) for m in match for x in range(m.size)]
        if not pairs:
            return None
        # Words that agree weigh what makes a span of LEAST_AGREED come out at nothing: the heaviest span agrees at least as much.
        best, weight, first, last, before = (0.0, 0, 0), 0.0, pairs[0][1], pairs[0][1] - 1, pairs[0][0] - 1
        for there, at in pairs:
            weight -= LEAST_AGREED * (at - last - 1) + SKIPPED * (there - before - 1)
            if weight <= 0:
                weight, first = 0.0, at
            weight, last, before = weight + 1 - LEAST_AGREED, at, there
            if weight > best[0] + 1e-9:
                best = (weight, first, at + 1)
        _, first, end = best
        held = [at for _, at in pairs if first <= at < end]
        return (first, end, held) if len(held) >= LEAST_SPAN else None

    def candidates(self, low: str, starts: list[int], k: int) -> Iterator[tuple[int, int]]:
        """Word ranges around the hits of a template, joined where they meet, in parts that share twice its reach."""
        reach, joined = self.reach[k], []
        for m in self.anchors[k].finditer(low):
            at = bisect_right(starts, m.start()) - 1
            begin, end = max(0, at - reach), min(len(starts), at + reach + 1)
            if joined and begin <= joined[-1][1]:
                joined[-1][1] = end
            else:
                joined.append([begin, end])
        for begin, end in joined:
            for at in range(begin, max(begin + 1, end - 2 * reach), 2 * reach):
                yield at, min(end, at + 4 * reach)

    def verdicts(self, text: str) -> list[tuple[str, float]]:
        """(name, gain) of each confirmed template, most savings first."""
        low = " ".join(text.lower().split())
        at: list = []
        found = []
        for k, t in enumerate(TEMPLATES):
            if not self.anchors[k].search(low):
                continue
            at = at or list(WORD.finditer(low))
            starts, own = [m.start() for m in at], [m.group() for m in at]
            for begin, end in self.candidates(low, starts, k):
                if (best := self.agreement(own[begin:end], k)) is None:
                    continue
                first, last, held = best[0] + begin, best[1] + begin, [x + begin for x in best[2]]
                wording = " ".join(own[x] for x in held)
                needed = [re.search(x, wording) for x in t.needed]
                if not all(needed):
                    continue
                # The words that tell this license from others.
                telling = held[wording.count(" ", 0, needed[0].start()) : wording.count(" ", 0, needed[0].end()) + 1]
                part = low[at[first].start() : at[last - 1].end()]
                data = part.encode()
                saved = len(self.alone(data)) - len(self.given[k](data))
                if saved >= LEAST_GAIN * len(self.alone(data)):
                    version = VERSION.search(low[at[first].start() : at[min(last + 1, len(at) - 1)].end()]) if t.name.startswith("CC-") else None
                    found.append((saved, len(held), t.name + (f"-{version.group()}" if version else ""), saved / len(self.alone(data)), set(held), telling))
        for m in SPDX_LINE.finditer(low):
            for name in [m[1], *re.split(r"\s+(?:or|and)\s+", m[2])[1:]]:
                if name in SPDX:
                    found.append((len(m[0]), 2, SPDX[name], 1.0, set(), [-1]))
        out: list[tuple[str, float]] = []
        taken: set[int] = set()
        for _, _, name, gain, held, telling in sorted(found, key=lambda x: (-x[0], -x[1], x[2])):
            if not taken.issuperset(telling):
                out.append((name, gain))
                taken |= held
        if any(name != "Proprietary" for name, _ in out):
            out = [x for x in out if x[0] != "Proprietary"]
        return out

    def scan(self, text: str | None) -> dict:
        found = self.verdicts(text or "")
        return {"licenses": ",".join(sorted({x[0] for x in found})), "n_blocks": len(found), "best_gain": round(max((x[1] for x in found), default=0.0), 6)}


def scan(docs: DataFrame) -> DataFrame:
    """docs with licenses (names, sorted, joined by commas), n_blocks and best_gain."""

    @F.pandas_udf("licenses string, n_blocks long, best_gain double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner()
        empty = scanner.scan("")
        for text in parts:
            yield pd.DataFrame([scanner.scan(t) if t else empty for t in text], columns=["licenses", "n_blocks", "best_gain"])

    made = ("licenses", "n_blocks", "best_gain")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    found = docs.select(own, run(F.when(F.col("text").rlike(CUES), F.col("text"))).alias("_found"))
    return found.select(*(F.col(f"_row.`{c}`") for c in docs.columns if c not in made), *(F.col(f"_found.{c}") for c in made))


def op9(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
