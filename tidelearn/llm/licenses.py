"""License scans: exact phrases, and short notices found with a bounded number of edits.

Texts are reduced to their words, one space apart.  A notice that may differ in k edits is
split into k + 1 pieces: whatever the edits, one piece stays whole, so exact search for
the pieces (one pass over the text for all notices) misses nothing.  Around each
piece that occurs the regex library's bounded-error matching verifies the notice
and gives its span.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import arrow_udf

from tidelearn.llm.registry import register, table

#: (phrase, label): found where the words stand consecutively.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: (notice, label, most edits)
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0", 4),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", 7),
    ("this work is licensed under a creative commons attribution", "cc-by", 5),
    ("licensed under cc by sa 4 0", "cc-by-sa", 2),
    ("licensed under cc by nc 4 0", "cc-by-nc", 2),
    ("licensed under cc by nd 4 0", "cc-by-nd", 2),
    ("terms of the gnu general public license", "gpl", 4),
    ("terms of the gnu lesser general public license", "lgpl", 4),
    ("subject to the terms of the mozilla public license v 2 0", "mpl-2.0", 5),
    ("released into the public domain", "public-domain", 3),
    ("all rights reserved", "reserved", 2),
    ("no part of this publication may be reproduced", "reserved", 4),
)

#: Bytes of a word keep (A-Z made lower case), all others become spaces: ASCII letters and digits, and everything beyond ASCII.
_WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


@dataclass(frozen=True)
class Scanner:
    phrases: Sequence[tuple[str, str]] = PHRASES
    notices: Sequence[tuple[str, str, int]] = NOTICES

    @cached_property
    def pieces(self) -> ahocorasick.Automaton:
        """Automaton over every notice's pieces; a piece knows its notices and where in them it begins."""
        found: dict[str, list[tuple[int, int]]] = {}
        for n, (notice, _, edits) in enumerate(self.notices):
            step, extra = divmod(len(notice), edits + 1)
            at = 0
            for k in range(edits + 1):
                size = step + (k < extra)
                found.setdefault(notice[at : at + size], []).append((n, at))
                at += size
        automaton = ahocorasick.Automaton()
        for piece, owners in found.items():
            automaton.add_word(piece, (len(piece), tuple(owners)))
        automaton.make_automaton()
        return automaton

    @cached_property
    def patterns(self) -> list[regex.Pattern]:
        """One fuzzy pattern per notice, whole words only."""
        return [regex.compile(rf"(?e)(?<![^ ])(?:{regex.escape(notice)}){{e<={edits}}}(?![^ ])") for notice, _, edits in self.notices]

    def places(self, plain: bytes) -> list[tuple[int, str]]:
        """(index of the first word, label) of each place of a phrase."""
        padded, found = b" " + plain + b" ", []
        spaces = np.flatnonzero(np.frombuffer(padded, np.uint8) == 0x20)
        for phrase, label in self.phrases:
            needle = b" " + phrase.encode() + b" "
            at = padded.find(needle)
            while at >= 0:
                found.append((int(np.searchsorted(spaces, at)), label))
                at = padded.find(needle, at + 1)
        return found

    def spans(self, plain: bytes) -> list[tuple[int, int, str, int]]:
        """(first word, words, label, edits) of each verified notice; of overlapping hits the one with the fewest edits counts."""
        text = plain.decode("utf-8", "replace")
        near: dict[int, list[tuple[int, int]]] = {}
        for end, (size, owners) in self.pieces.iter(text):
            for n, offset in owners:
                notice, _, edits = self.notices[n]
                start = end - size + 1 - offset
                near.setdefault(n, []).append((start - edits, start + len(notice) + edits))
        if not near:
            return []
        out = []
        spaces = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 0x20)
        for n, ranges in near.items():
            _, label, _ = self.notices[n]
            ranges.sort()
            merged: list[list[int]] = []
            for a, b in ranges:
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            for a, b in merged:
                a, b = max(a, 0), min(b, len(text))
                # The pattern looks one character beyond on both sides for a word's edge.
                for hit in self.patterns[n].finditer(text, max(a - 1, 0), min(b + 1, len(text))):
                    out.append((int(np.searchsorted(spaces, hit.start())), len(hit.group().split()), label, sum(hit.fuzzy_counts)))
        kept: list[tuple[int, int, str, int]] = []
        taken = bytearray(len(spaces) + 1)  # words of kept hits
        for hit in sorted(set(out), key=lambda h: (h[3], -h[1], h)):
            a, b = hit[0], hit[0] + hit[1]
            if taken.find(1, a, b) < 0:
                taken[a:b] = b"\x01" * (b - a)
                kept.append(hit)
        return sorted(kept)


FOUND = (
    "struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,labels:string,score:double,"
    "spans:array<struct<word:bigint,words:bigint,label:string,edits:bigint>>>"
)


def scan_text(scanner: Scanner, text: str) -> dict:
    split = text.encode().translate(_WORDS).split()
    plain = b" ".join(split)
    base, spans = scanner.places(plain), scanner.spans(plain)
    own = {label for _, label in base}
    score = 1.0 if base else max((1 - e / (4 * max(w, 1)) for _, w, _, e in spans), default=0.0)
    return {
        "n_words": len(split),
        "n_base": len(base),
        "first_word": min(base)[0] if base else None,
        "last_word": max(base)[0] if base else None,
        "base_labels": ",".join(sorted(own)),
        "labels": ",".join(sorted(own | {label for _, _, label, _ in spans})),
        "score": max(0.0, score),
        "spans": [dict(zip(("word", "words", "label", "edits"), s)) for s in spans],
    }


def scan(docs: DataFrame, text: str = "text", scanner: Scanner = Scanner()) -> DataFrame:
    """``docs`` with a struct column ``licenses``; a column of that name is replaced.

    It holds n_words, the phrases' places (n_base, first_word, last_word, base_labels), labels with those
    of fuzzy notices, a score (1 with a phrase, else less by the best notice's edits, else 0) and the spans of the
    notices.  Null and empty texts have no words, null first and last word, no
    labels and score 0.  Whole texts are searched; an empty table gives no rows.
    """

    @arrow_udf(FOUND)
    def found(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct(
            [(n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")]
            + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
            + [("spans", pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int64()), ("label", pa.string()), ("edits", pa.int64())])))]
        )
        for texts in column:
            yield pa.array([scan_text(scanner, t.as_py() or "") for t in texts], kind)

    return docs.withColumn("licenses", found(F.col(text)))


@register("op9_licenses")
def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of all documents."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    return found.select("doc_id", *[F.col(f"licenses.{n}").alias(n) for n in names], F.size("licenses.spans").alias("n_spans"))
