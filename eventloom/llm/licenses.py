"""License scans by ordered signature rules.

Texts become lower-case words; hundreds of regular expressions over the words, each gated by its keywords, give intervals
of words; rules are ordered by priority, and an interval that lies within an accepted one is suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases and labels of the base.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Label, keywords of which one must begin a word of each name, the license's names and its short ids, as expressions
#: over words.
FAMILIES: tuple[tuple[str, str, str, str], ...] = (
    ("mit", "mit expat", "(?:mit|expat)", "mit"),
    ("mit-0", "mit", "mit no attribution", "mit 0"),
    ("x11", "x11", "x11", "x11"),
    ("isc", "isc", "isc", "isc"),
    ("0bsd", "0bsd zero", "(?:zero clause bsd|0bsd)", "0bsd"),
    ("bsd-2-clause", "bsd freebsd", "(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", "(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", "(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)", "bsd 4 clause"),
    ("apache-1.1", "apache", "apache(?: software)? license(?: version)? 1 1", "apache 1 1"),
    ("apache-2", "apache", "apache(?: software)? license(?: version| v)? 2(?: 0)?", "apache 2 0"),
    ("gpl-1", "gpl", "(?:gnu )?gpl(?: version| v)? 1(?: 0)?", "gpl 1 0(?: only| or later)?"),
    ("gpl-2", "gpl", "(?:gnu )?gpl(?:v2| version 2| v2| 2)(?: 0)?", "gpl 2 0(?: only| or later)?"),
    ("gpl-3", "gpl", "(?:gnu )?gpl(?:v3| version 3| v3| 3)(?: 0)?", "gpl 3 0(?: only| or later)?"),
    ("gpl-2", "general", "gnu general public license(?: as published by the free software foundation)?(?: either)? (?:version|v) 2", "gpl2"),
    ("gpl-3", "general", "gnu general public license(?: as published by the free software foundation)?(?: either)? (?:version|v) 3", "gpl3"),
    ("gpl", "general", "gnu general public license", "gnu gpl"),
    ("lgpl-2", "lgpl", "(?:gnu )?lgpl(?: version| v)? 2(?: 0)?", "lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "lgpl", "(?:gnu )?lgpl(?:v2| version 2| v2| 2) 1", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-3", "lgpl", "(?:gnu )?lgpl(?:v3| version 3| v3| 3)(?: 0)?", "lgpl 3 0(?: only| or later)?"),
    ("lgpl-2.1", "lesser", "gnu lesser general public license(?: as published by the free software foundation)?(?: either)? (?:version|v) 2 1", "lgpl21"),
    ("lgpl-3", "lesser", "gnu lesser general public license(?: as published by the free software foundation)?(?: either)? (?:version|v) 3", "lgpl3"),
    ("lgpl", "lesser", "gnu lesser general public license", "gnu lgpl"),
    ("agpl-3", "affero", "gnu affero general public license(?: (?:version|v) 3)?", "gnu affero"),
    ("agpl-3", "agpl", "(?:gnu )?agpl(?:v3| version 3| v3| 3)?(?: 0)?", "agpl 3 0(?: only| or later)?"),
    ("mpl-1.1", "mozilla", "mozilla public license(?: version| v)? 1 1", "mozilla 1 1"),
    ("mpl-2.0", "mozilla", "mozilla public license(?: version| v)? 2(?: 0)?", "mozilla 2 0"),
    ("mpl-1.1", "mpl", "mpl(?: version| v)? 1 1", "mpl 1 1"),
    ("mpl-2.0", "mpl", "mpl(?: version| v)? 2(?: 0)?", "mpl 2 0"),
    ("epl-1.0", "eclipse", "eclipse public license(?: version| v)? 1(?: 0)?", "epl 1 0"),
    ("epl-2.0", "eclipse", "eclipse public license(?: version| v)? 2(?: 0)?", "epl 2 0"),
    ("edl-1.0", "eclipse", "eclipse distribution license(?: version| v)? 1(?: 0)?", "edl 1 0"),
    ("eupl-1.1", "eupl european", "(?:european union public licen[cs]e|eupl)(?: version| v)? 1 1", "eupl 1 1"),
    ("eupl-1.2", "eupl european", "(?:european union public licen[cs]e|eupl)(?: version| v)? 1 2", "eupl 1 2"),
    ("cddl-1.0", "cddl", "cddl(?: version| v)? 1 0", "cddl 1 0"),
    ("cddl-1.1", "cddl", "cddl(?: version| v)? 1 1", "cddl 1 1"),
    ("cpl-1.0", "common", "common public license(?: version| v)?(?: 1)?(?: 0)?", "cpl 1 0"),
    ("artistic-1.0", "artistic", "artistic license(?: version| v)? 1(?: 0)?", "artistic 1 0"),
    ("artistic-2.0", "artistic", "artistic license(?: version| v)? 2(?: 0)?", "artistic 2 0"),
    ("bsl-1.0", "boost", "boost software license(?: version| v)?(?: 1)?(?: 0)?", "bsl 1 0"),
    ("busl-1.1", "business", "business source license(?: version| v)?(?: 1)?(?: 1)?", "busl 1 1"),
    ("sspl-1.0", "side", "server side public license(?: version| v)?(?: 1)?(?: 0)?", "sspl 1 0"),
    ("elastic-2.0", "elastic", "elastic license(?: version| v)?(?: 2)?(?: 0)?", "elastic 2 0"),
    ("zlib", "zlib", "zlib(?: libpng)?", "zlib"),
    ("libpng", "libpng", "libpng", "libpng 2 0"),
    ("unlicense", "unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl", "wtfpl"),
    ("cc0-1.0", "cc0", "(?:creative commons )?cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("ofl-1.1", "ofl", "(?:sil )?ofl(?: 1 1)?", "ofl 1 1"),
    ("ofl-1.1", "font", "sil open font license(?: version| v)?(?: 1)?(?: 1)?", "open font 1 1"),
    ("postgresql", "postgresql", "postgresql", "postgresql"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)?", "ncsa"),
    ("openssl", "openssl", "openssl", "openssl"),
    ("php-3.01", "php", "php license(?: version| v)? 3(?: 0| 01)", "php 3 01"),
    ("python-2.0", "python", "python software foundation license(?: version| v)?(?: 2)?(?: 0)?", "psf 2 0"),
    ("ruby", "ruby", "ruby", "ruby"),
    ("zpl-2.1", "zope", "zope public license(?: version| v)?(?: 2)?(?: 1)?", "zpl 2 1"),
    ("w3c", "w3c", "w3c(?: software)?", "w3c"),
    ("afl-3.0", "academic", "academic free license(?: version| v)?(?: 3)?(?: 0)?", "afl 3 0"),
    ("ecl-2.0", "educational", "educational community license(?: version| v)?(?: 2)?(?: 0)?", "ecl 2 0"),
    ("apsl-2.0", "apple", "apple public source license(?: version| v)?(?: 2)?(?: 0)?", "apsl 2 0"),
    ("ms-pl", "microsoft", "microsoft public license", "ms pl"),
    ("ms-rl", "microsoft", "microsoft reciprocal license", "ms rl"),
    ("lppl-1.3c", "latex", "latex project public license(?: version| v)?(?: 1)?(?: 3c?)?", "lppl 1 3c"),
    ("vim", "vim", "vim", "vim"),
    ("json", "json", "json", "json"),
    ("beerware", "beerware", "beerware", "beerware"),
    ("odbl-1.0", "database", "open database license(?: version| v)?(?: 1)?(?: 0)?", "odbl 1 0"),
    ("odc-by-1.0", "odc commons", "(?:open data commons|odc)(?: attribution| by)(?: 1)?(?: 0)?", "odc by 1 0"),
    ("pddl-1.0", "pddl", "pddl(?: 1 0)?", "pddl 1 0"),
    ("gfdl-1.3", "gfdl", "gfdl(?: 1 3)?", "gfdl 1 3(?: only| or later)?"),
    ("gfdl-1.3", "documentation", "gnu free documentation license(?: version| v)?(?: 1)?(?: 3)?", "gnu fdl 1 3"),
    ("openrail", "openrail", "(?:creativeml )?openrail(?: m)?", "openrail m"),
)

#: The six Creative Commons deeds, as words.
DEEDS = ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd")
#: Words of the deeds' long names.
DEED_NAMES = {"by": "attribution", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?", "sa": "share ?alike"}
#: Templates, strongest first: expression, priority, confidence. {n}: name, {i}: short id.
TEMPLATES: tuple[tuple[str, int, float], ...] = (
    ("spdx license identifier {i}", 60, 1.0),
    ("(?:opensource|spdx) org licenses? {i}", 50, 0.95),
    ("(?:licen[cs]ed|released|distributed|available|published) under(?: the)?(?: terms of(?: the)?)? {n}(?: licen[cs]e)?", 40, 0.95),
    ("under(?: the)?(?: terms of(?: the)?)? {n} licen[cs]e", 35, 0.9),
    ("{n} licen[cs]e", 30, 0.8),
    ("licen[cs]e {i}", 20, 0.6),
)


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    priority: int
    confidence: float
    more: tuple[str, ...] = ()  # keywords of the alternatives that don't hold keyword


@cache
def rules() -> tuple[Rule, ...]:
    """All rules, in the order in which they are tried: by priority, then as listed."""
    made, alone = [], []
    for label, keys, name, short in FAMILIES:
        key, *more = keys.split()
        own = key if key in short.split() else short.split()[0]  # of the short id
        for t, p, c in TEMPLATES:
            named = "{n}" in t
            made.append(Rule(label, key if named else own, t.format(n=name, i=short), p, c, tuple(more) if named else ()))
        # a name that holds the word license or a version says enough by itself
        if re.search(r"licen|gpl|mpl |cddl|eupl", name):
            alone.append(Rule(label, key, name, 25, 0.7, tuple(more)))
    made += alone
    for deed in DEEDS:
        label, longer = "cc-" + deed.replace(" ", "-"), " ".join(DEED_NAMES[x] for x in deed.split())
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            made.append(Rule(label, "cc", f"spdx license identifier cc {deed} {version}", 60, 1.0))
            made.append(Rule(label, "cc", f"cc {deed} {version}", 40, 0.9))
            made.append(Rule(label, "creativecommons", f"creativecommons org licenses {deed} {version}", 50, 0.95))
            made.append(Rule(label, "creative", f"creative commons {longer}(?: licen[cs]e)?(?: {version})(?: international| unported)?", 45, 0.95))
        made.append(Rule(label, "cc", f"cc {deed}", 20, 0.7))
        made.append(Rule(label, "creative", f"creative commons {longer}(?: licen[cs]e)?", 30, 0.85))
    made.append(Rule("proprietary", "reserved", "all rights reserved", 5, 0.4))
    made.append(Rule("public-domain", "domain", "(?:dedicated to|released into|in) the public domain", 30, 0.8))
    # a longer deed before a shorter one of the same priority
    return tuple(sorted(made, key=lambda r: (-r.priority, -len(r.pattern))))


_PLAIN = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def plain_words(text: str) -> list[bytes]:
    """Runs of digits, letters a to z (A to Z lower-cased) and characters beyond ASCII."""
    return text.encode("utf-8", "replace").translate(_PLAIN).split()


class _Reach:
    """The greatest end of the intervals that begin at or before a place, by a tree of prefix maxima."""

    def __init__(self):
        self.most: dict[int, int] = {}
        self.size = 1 << 40

    def add(self, start: int, end: int) -> None:
        k = start + 1
        while k <= self.size:
            if self.most.get(k, -1) < end:
                self.most[k] = end
            k += k & -k

    def upto(self, start: int) -> int:
        k, end = start + 1, -1
        while k > 0:
            end = max(end, self.most.get(k, -1))
            k -= k & -k
        return end


class Scanner:
    def __init__(self):
        import ahocorasick

        self.rules = [(r, frozenset((r.keyword, *r.more)), re.compile(f"(?= ({r.pattern}) )")) for r in rules()]
        self.gate = ahocorasick.Automaton()
        for key in {key for _, own, _ in self.rules for key in own}:
            self.gate.add_word(f" {key}", key)
        self.gate.make_automaton()
        self.base = [(label, f" {phrase} ") for phrase, label in BASE.items()]

    def scan(self, text: str) -> tuple[int, list[dict], list[dict]]:
        """Number of words, base places, accepted detections; start and end are numbers of words, end not included."""
        found = plain_words(text)
        line = f" {b' '.join(found).decode()} "
        base, took, at, spaces = [], [], line.find, []
        accepted = _Reach()

        def word(k: int) -> int:
            """The number of the word after the space at k."""
            if not spaces:
                spaces.extend(accumulate((len(w.decode()) + 1 for w in found), initial=0))
            return bisect_left(spaces, k)

        for label, phrase in self.base:
            k = at(phrase)
            while k >= 0:
                start = word(k)
                base.append({"label": label, "start": start, "end": start + phrase.count(" ") - 1})
                k = at(phrase, k + 1)
        if keys := {key for _, key in self.gate.iter(line)}:
            for rule, own, pattern in self.rules:
                for m in () if own.isdisjoint(keys) else pattern.finditer(line):
                    start = word(m.start())
                    end = start + m[1].count(" ") + 1
                    if accepted.upto(start) < end:
                        accepted.add(start, end)
                        took.append({"label": rule.label, "start": start, "end": end, "priority": rule.priority, "confidence": rule.confidence})
        return len(found), base, took


_PLACE = "struct<label:string,start:long,end:long>"
_FOUND = "struct<label:string,start:long,end:long,priority:int,confidence:double>"
_ARROW_PLACE = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_ARROW_FOUND = pa.struct([*_ARROW_PLACE, ("priority", pa.int32()), ("confidence", pa.float64())])


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, base, found) of each document: base places of the base phrases, found the accepted detections.

    Rules are tried by priority; a detection within an accepted interval is dropped, overlapping ones both stay. A
    null text is an empty one, without words and finds. Repeated rows are scanned alike and all stay; other columns
    are not looked at; an empty table gives no rows.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            rows = [scanner.scan(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(_ARROW_PLACE)), pa.array([r[2] for r in rows], pa.list_(_ARROW_FOUND))],
                [key, "n_words", "base", "found"],
            )

    picked = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return picked.mapInArrow(run, f"`{key}` {kind}, n_words long, base array<{_PLACE}>, found array<{_FOUND}>")
