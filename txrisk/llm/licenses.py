"""Licence scans: identifier tags and notice phrases by Aho-Corasick.

One automaton finds notice phrases, whole words in sequence, in the words of a
text; another finds identifier tags in its lower-cased characters. Of phrases
that overlap the leftmost counts, of those the longest; places and labels of the
base phrases count wherever they stand.

What follows a tag on its line is a licence expression of ids, ``and``, ``or``,
``with`` and parentheses, which a shunting-yard parser brings into postfix order
and evaluates. ``and``: every label of both sides holds, with the confidence of
the weaker one. ``or``: one label with the alternatives, ``a|b``, with that of
the stronger one. ``with``: the licence with its exception, ``a-with-x``. Ids
that are not known give no label; a choice is then what is known of it.

Null and empty texts have no words, no labels and the score 0; long ones are
scanned whole. Expressions that do not parse give no label and a low score.
Repeated rows are scanned alike; null ids are kept; an empty table gives no
rows; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base phrases and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
BASE_SCORE = 0.9

# Notice phrases with label and confidence.
NOTICES = {
    "gnu general public license": ("gpl", 0.9),
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "bsd license": ("bsd", 0.8),
    "mit license": ("mit", 0.8),
    "isc license": ("isc", 0.8),
    "apache license": ("apache", 0.7),
    "creative commons attribution": ("cc-by", 0.8),
    "cc by sa": ("cc-by-sa", 0.9),
    "cc by nd": ("cc-by-nd", 0.9),
    "cc0 1 0": ("cc0", 0.9),
    "permission is hereby granted free of charge": ("mit", 0.8),
    "redistribution and use in source and binary forms": ("bsd", 0.8),
    "released into the public domain": ("public-domain", 0.8),
    "all rights reserved": ("all-rights-reserved", 0.6),
}

TAGS = ("spdx-license-identifier:", "license-expression:")

def _versions(names: str, versions: str, endings: str = "") -> list[str]:
    return [f"{n}-{v}{e}" for n in names.split() for v in versions.split() for e in ("", *endings.split())]


# Public licence identifiers, families by their versions.
KNOWN_IDS = frozenset(
    "0bsd aal adsl aml ampas antlr-pd apl-1.0 arphic-1999 artistic-1.0 artistic-2.0 bitstream-vera blessing"
    " blueoak-1.0.0 bsl-1.0 bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear"
    " bsd-3-clause-lbnl bsd-4-clause busl-1.1 bzip2-1.0.6 cal-1.0 catosl-1.1 cc-pddc cc0-1.0 cecill-2.1"
    " cecill-b cecill-c curl ecl-2.0 efl-2.0 elastic-2.0 entessa fair ftl hpnd icu ijg imagemagick"
    " intel ipa isc jpnic json latex2e libpng libpng-2.0 libtiff lppl-1.3c mit mit-0 mit-cmu mit-modern-variant"
    " mitnfa mirros ms-pl ms-rl mulanpsl-2.0 multics nasa-1.3 naumen ncsa netcdf ngpl nist-pd nokia nposl-3.0 ntp"
    " odbl-1.0 odc-by-1.0 ofl-1.0 ofl-1.1 ogtsl oldap-2.8 openssl osl-3.0 pddl-1.0 php-3.01 postgresql psf-2.0"
    " python-2.0 qpl-1.0 ruby sgi-b-2.0 sissl sleepycat spl-1.0 sspl-1.0 tcl unicode-dfs-2016 unlicense upl-1.0"
    " vim w3c wtfpl x11 xnet zlib zpl-2.1".split()
    + _versions("apache", "1.0 1.1 2.0")
    + _versions("afl", "1.1 1.2 2.0 2.1 3.0")
    + _versions("cc-by cc-by-nc cc-by-nd cc-by-sa cc-by-nc-nd cc-by-nc-sa", "1.0 2.0 2.5 3.0 4.0")
    + _versions("epl", "1.0 2.0") + _versions("eupl", "1.0 1.1 1.2") + _versions("cddl", "1.0 1.1")
    + _versions("mpl", "1.0 1.1 2.0")
    + _versions("gpl", "1.0 2.0 3.0", "-only -or-later")
    + _versions("lgpl", "2.0 2.1 3.0", "-only -or-later")
    + _versions("agpl", "1.0 3.0", "-only -or-later")
    + _versions("gfdl", "1.1 1.2 1.3", "-only -or-later")
)
EXCEPTIONS = frozenset(
    "classpath-exception-2.0 llvm-exception gcc-exception-2.0 gcc-exception-3.1 autoconf-exception-2.0"
    " autoconf-exception-3.0 bison-exception-2.2 font-exception-2.0 libtool-exception linux-syscall-note"
    " openvpn-openssl-exception qt-gpl-exception-1.0 swift-exception u-boot-exception-2.0 wxwindows-exception-3.1".split()
)
UNKNOWN_ID_SCORE = 0.5
UNPARSED_SCORE = 0.3

BINDING = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"\(|\)|[a-z0-9.+:-]+")
_NO_EXPRESSION = re.compile(r"[^a-z0-9.+:() \t-]")

# Bytes to a word's bytes: A-Z in lower case, other ASCII but digits and letters to blanks.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)

SCHEMA = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint,"
    " base_labels string, labels string, score double"
)
_ARROW = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
_NAMES = [f.split()[0] for f in SCHEMA.split(", ")]


def postfix(expression: str) -> list[str]:
    """The tokens of a licence expression in postfix order; ValueError if it is none."""
    out, stack, operand_next = [], [], True
    for token in _TOKEN.findall(expression):
        if token == "(":
            if not operand_next:
                raise ValueError("operator expected")
            stack.append(token)
        elif token in BINDING:
            if operand_next:
                raise ValueError("operand expected")
            while stack and stack[-1] != "(" and BINDING[stack[-1]] >= BINDING[token]:
                out.append(stack.pop())
            stack.append(token)
            operand_next = True
        elif operand_next and token == ")":
            raise ValueError("operand expected")
        elif token == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                raise ValueError("parenthesis not opened")
            stack.pop()
        else:
            if not operand_next:
                raise ValueError("operator expected")
            out.append(token)
            operand_next = False
    if operand_next:
        raise ValueError("operand expected")
    while stack:
        if stack[-1] == "(":
            raise ValueError("parenthesis not closed")
        out.append(stack.pop())
    return out


def _one(labels: frozenset[str]) -> str:
    """Labels that hold together as one alternative."""
    if len(labels) == 1:
        return next(iter(labels))
    return "&".join(sorted(f"({x})" if "|" in x else x for x in labels))


def _either(a: frozenset[str], b: frozenset[str]) -> frozenset[str]:
    if not a or not b or a == b:
        return a or b
    # a choice among choices is one choice
    alternatives = {x for side in (a, b) for x in (_one(side).split("|") if len(side) == 1 else [_one(side)])}
    return frozenset(["|".join(sorted(alternatives))])


def evaluate(expression: str) -> tuple[frozenset[str], float]:
    """Labels of an expression, which all hold, and its confidence."""
    values: list[tuple[frozenset[str], float]] = []
    for token in postfix(expression):
        if token not in BINDING:
            known = token.removesuffix("+") in KNOWN_IDS or token in EXCEPTIONS
            values.append((frozenset([token] if known else []), 1.0 if known else UNKNOWN_ID_SCORE))
            continue
        (b, q), (a, p) = values.pop(), values.pop()
        if token == "or":
            values.append((_either(a, b), max(p, q)))
        elif token == "and":
            values.append((a | b, min(p, q)))
        elif b <= EXCEPTIONS and b:
            values.append((frozenset(f"{x}-with-{_one(b)}" for x in a), min(p, q)))
        else:
            values.append((a, min(p, UNKNOWN_ID_SCORE)))
    labels, confidence = values[0]
    return labels - EXCEPTIONS, confidence


def automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    """For phrases between blanks, and for tags."""
    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase, (label, score) in NOTICES.items():
        phrases.add_word(f" {phrase} ", (len(phrase) + 2, False, label, score))
    for phrase, label in BASE_PHRASES.items():
        phrases.add_word(f" {phrase} ", (len(phrase) + 2, True, label, BASE_SCORE))
    for tag in TAGS:
        tags.add_word(tag, len(tag))
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def scan_text(text: str | None, phrases, tags) -> tuple:
    """The columns of SCHEMA for one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(_WORD_BYTES).split()
    line = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    n_base, first, last, base, labels, score = 0, None, None, set(), set(), 0.0
    counted_to = blanks = 0
    matches = []
    for end, (length, is_base, label, confidence) in phrases.iter(line):
        start = end + 1 - length
        matches.append((start, -length, label, confidence))
        if is_base:
            if start >= counted_to:
                blanks += line.count(" ", counted_to, start)
                at = blanks
                counted_to = start
            else:  # a longer phrase that began before the last one
                at = blanks - line.count(" ", start, counted_to)
            n_base += 1
            base.add(label)
            score = max(score, confidence)
            first = at if first is None else min(first, at)
            last = at if last is None else max(last, at)
    labels |= base
    free = 0
    for start, less, label, confidence in sorted(matches):
        if start >= free:  # leftmost, then longest; the blank between two phrases is of both
            free = start - less - 1
            labels.add(label)
            score = max(score, confidence)
    lower = raw.lower().decode("utf-8", "surrogatepass")
    for end, _ in tags.iter(lower):
        stop = lower.find("\n", end + 1)
        rest = lower[end + 1 : len(lower) if stop < 0 else stop]
        rest = _NO_EXPRESSION.split(rest, maxsplit=1)[0].strip()
        try:
            ids, confidence = evaluate(rest)
        except ValueError:
            ids, confidence = frozenset(), UNPARSED_SCORE
        labels |= ids
        score = max(score, confidence)
    found = (",".join(sorted(base)), ",".join(sorted(labels)))
    return (len(words), n_base, first, last, *found, score)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and the columns of SCHEMA, a row for each row of ``docs``.

    ``n_base`` counts places of base phrases, ``first_word`` and ``last_word``
    are the smallest and largest start among them, in words from 0.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, tags = automata()
        for batch in batches:
            rows = [scan_text(t.as_py(), phrases, tags) for t in batch.column("text")]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_NAMES)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, columns, _ARROW)], ["doc_id", *_NAMES]
            )

    return source.mapInArrow(run, f"doc_id {id_type}, {SCHEMA}")
