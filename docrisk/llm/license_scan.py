"""Licence scan: exact phrases by word, plus short notices that may carry a few edits.

Base phrases are counted at every place where their words stand consecutively. Notices are searched by
the pigeonhole rule: a notice that occurs with at most ``k`` edits has one of its ``k + 1`` pieces
unchanged, so pieces are looked up as plain substrings and only the text around a hit is matched with the
bounded-error form of the ``regex`` library, which also gives the span. Around the best match the rest of the text is searched
on both sides. Before that, blanks, line ends and comment marks at the start of lines become one space; spans are
given in the text as it was.

Nulls and empty texts have no words and no labels; texts of any length are scanned whole; repeated rows
give repeated results; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Notices searched with edits: (text in lower case with single spaces, label, most edits).
NOTICES = (
    ("licensed under the gnu general public license", "gpl", 4),
    ("gnu lesser general public license", "lgpl", 3),
    ("licensed under the apache license version 2.0", "apache", 4),
    ("licensed under cc by-sa", "cc-by-sa", 2),
    ("licensed under cc by-nc", "cc-by-nc", 2),
    ("creative commons attribution", "cc-by", 3),
    ("released under the mit license", "mit", 3),
    ("permission is hereby granted, free of charge", "mit", 4),
    ("redistribution and use in source and binary forms", "bsd", 5),
    ("mozilla public license", "mpl", 2),
    ("all rights reserved", "all-rights-reserved", 1),
)
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
    "labels string, score double, spans array<struct<label:string,start:int,stop:int,edits:int>>"
)
# Blanks that are not a single space; after a line end also the marks a comment's lines begin with.
BREAK = re.compile(r"""\s*[\r\n](?:\s|[*/#;%!>'"|-]|(?:dnl|rem)(?=\s))*|[^\S\r\n ]\s*|  +""")
_LOWER = {c: c + 32 for c in range(65, 91)}
# Word bytes of the lower-cased UTF-8 text: digits, a-z, everything outside ASCII.
_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True


def count_words(data: bytes) -> int:
    flags = _IS_WORD[np.frombuffer(data, np.uint8)]
    return int(flags[:1].sum() + np.count_nonzero(flags[1:] & ~flags[:-1])) if len(flags) else 0


def base_matchers(phrases: dict[str, str]) -> list[tuple[str, re.Pattern, str]]:
    out = []
    for phrase, label in phrases.items():
        words = phrase.split(" ")
        body = f"{GAP}+".join(map(re.escape, words))
        # The lookahead keeps every start, also of places that overlap.
        out.append((max(words, key=len), re.compile(f"(?<!{WORD})(?={body}(?!{WORD}))"), label))
    return out


def seeds(notice: str, edits: int) -> list[tuple[str, int]]:
    """``edits + 1`` pieces of nearly equal length with their offsets."""
    cuts = [round(i * len(notice) / (edits + 1)) for i in range(edits + 2)]
    return [(notice[a:b], a) for a, b in zip(cuts, cuts[1:])]


def notice_matchers(notices=NOTICES) -> list[tuple]:
    # BESTMATCH gives the form with the fewest edits inside the window.
    return [
        (text, label, k, seeds(text, k), regex.compile(f"(?:{regex.escape(text, literal_spaces=True)}){{e<={k}}}", regex.BESTMATCH))
        for text, label, k in notices
    ]


def find_notices(text: str, matchers) -> list[tuple[str, int, int, int, float]]:
    """(label, start, stop, edits, likeness) of every notice place, best form of each."""
    found = []
    for notice, label, most, parts, pattern in matchers:
        windows = []
        for piece, offset in parts:
            at = text.find(piece)
            while at >= 0:
                windows.append((max(0, at - offset - most), min(len(text), at - offset + len(notice) + most)))
                at = text.find(piece, at + 1)
        merged: list[list[int]] = []
        for a, b in sorted(windows):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        least = len(notice) - most
        rest = merged
        while rest:
            a, b = rest.pop()
            if b - a >= least and (hit := pattern.search(text, a, b)):
                edits = sum(hit.fuzzy_counts)
                found.append((label, hit.start(), hit.end(), edits, 1 - edits / len(notice)))
                rest += [[a, hit.start()], [max(hit.end(), hit.start() + 1), b]]
    return found


def collapsed(text: str) -> tuple[str, list[int], list[int]]:
    """``text`` with single spaces, and where, in it, how many characters are missing so far."""
    out, at, size, places, missing = [], 0, 0, [0], [0]
    for m in BREAK.finditer(text):
        out += [text[at : m.start()], " "]
        size += m.start() - at + 1
        at = m.end()
        places.append(size)
        missing.append(at - size)
    return "".join([*out, text[at:]]), places, missing


def notice_spans(text: str, matchers) -> list[tuple[str, int, int, int, float]]:
    """As ``find_notices``, in any layout of blanks and comment marks."""
    flat, places, missing = collapsed(text)
    place = lambda at: at + missing[bisect_right(places, at) - 1]
    return [(label, place(a), place(b - 1) + 1, *more) for label, a, b, *more in find_notices(flat, matchers)]


def scan_text(text: str, bases, notices) -> tuple:
    low = text.translate(_LOWER) if not text.isascii() else text.lower()
    data = low.encode("utf-8", "surrogatepass")
    starts, base = [], set()
    for rare, pattern, label in bases:
        if rare in low:
            hits = [m.start() for m in pattern.finditer(low)]
            if hits:
                base.add(label)
                starts += hits
    first = last = None
    if starts:
        words_before = lambda at: count_words(low[:at].encode("utf-8", "surrogatepass"))
        first, last = words_before(min(starts)), words_before(max(starts))
    spans = notice_spans(low, notices)
    labels = base | {s[0] for s in spans}
    score = 1.0 if base else max((s[4] for s in spans), default=0.0)
    return count_words(data), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, [s[:4] for s in sorted(spans, key=lambda s: s[1:3])]


def scan(docs: DataFrame, phrases: dict[str, str] = BASE, notices=NOTICES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) with base counts, labels, score and spans in code points."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bases, fuzzy = base_matchers(phrases), notice_matchers(notices)
        for batch in batches:
            rows = [scan_text(t or "", bases, fuzzy) for t in batch["text"]]
            out = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])
            for c in ("first_word", "last_word"):
                out[c] = out[c].astype("Int64")
            out["spans"] = [[{"label": a, "start": b, "stop": c, "edits": d} for a, b, c, d in s] for s in out["spans"]]
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, SCHEMA)
