"""Licence scans.

One Aho-Corasick automaton finds phrases of notices and identifier tags among the words of each whole text, a second one
the tags as they stand; there a shunting-yard parser reads the licence expression (and, or, with, +, brackets) of known
names into postfix order. From it come the labels, the expression in its own form, never multiplied out, and by
`evaluate` whether it holds for given licences. Every step is linear in the text.

Words are runs of letters, digits and characters beyond ASCII, ASCII letters lowered. A phrase stands where its
words stand one after another. The base phrases give the base labels; the method adds the labels of further phrases
and of the tags' expressions. The score is the noisy-or of what was found: a notice phrase weighs less than a tag.

Defined results: a null or empty text has no words, no labels and the score 0. A tag with no readable expression
adds no label; an expression ends before a word that is no licence's name, at its line's end, or at the next tag. Repeated rows give repeated results. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm.common import named, ship, table

# The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Phrases of the method's own, with label and weight.
MORE = {
    "licensed under the apache license version 2 0": ("apache-2.0", 0.95),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.95),
    "gnu general public license version 2": ("gpl-2.0", 0.9),
    "gnu general public license version 3": ("gpl-3.0", 0.9),
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "bsd license": ("bsd", 0.8),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "isc license": ("isc", 0.8),
    "boost software license": ("bsl-1.0", 0.9),
    "creative commons attribution": ("cc-by", 0.8),
    "cc by": ("cc-by", 0.6),
    "cc by nc": ("cc-by-nc", 0.8),
    "cc by sa": ("cc-by-sa", 0.8),
    "cc by nd": ("cc-by-nd", 0.8),
    "cc by nc sa": ("cc-by-nc-sa", 0.8),
    "cc by nc nd": ("cc-by-nc-nd", 0.8),
    "cc0": ("cc0", 0.6),
    "public domain": ("public-domain", 0.5),
    "all rights reserved": ("proprietary", 0.5),
}
BASE_WEIGHT, TAG_WEIGHT = 0.8, 0.98
TAG = "spdx license identifier"
TAGS = ("spdx-license-identifier", "spdx license identifier")  # as they stand in texts
NOT_WORD = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BEHIND_TAG = re.compile(r"[ \t]*:?[ \t]*")
TOKEN = re.compile(r"[ \t]*(?:([()])|([a-z0-9](?:[a-z0-9.:-]*[a-z0-9])?\+?))")
# The names that an expression may hold, of public licence identifiers; families by their rule.
NAMES = (
    "0bsd aal apsl-2.0 artistic-1.0 artistic-2.0 beerware blessing bsl-1.0 busl-1.1 cc0-1.0 cddl-1.0 cddl-1.1 cpl-1.0 curl ecl-2.0 etalab-2.0 fsfap ftl hpnd icu ijg imagemagick "
    "info-zip intel ipl-1.0 isc jasper-2.0 json libpng libtiff mit mit-0 mit-cmu mit-modern-variant mpl-1.0 mpl-1.1 mpl-2.0 mpl-2.0-no-copyleft-exception ms-pl ms-rl mulanpsl-2.0 "
    "naist-2003 ncsa netcdf nist-pd ntp odbl-1.0 odc-by-1.0 openssl pddl-1.0 postgresql psf-2.0 python-2.0 qpl-1.0 ruby sleepycat smlnj spl-1.0 sspl-1.0 tcl "
    "tcp-wrappers unicode-3.0 unicode-dfs-2016 unlicense upl-1.0 vim vsl-1.0 w3c wtfpl x11 xnet zend-2.0 zlib zlib-acknowledgement"
)
FAMILIES = (
    r"[al]?gpl-[123]\.[01](?:-only|-or-later|\+)?|gfdl-1\.[123](?:-only|-or-later)?|apache-(?:1\.0|1\.1|2\.0)|bsd-[1234]-clause(?:-[a-z0-9-]+)?|cc-(?:by(?:-nc)?(?:-nd|-sa)?|pddc)(?:-[1234]\.[05])?(?:-[a-z]{2,3})?"
    r"|afl-[123]\.[0-2]|osl-[123]\.[01]|epl-[12]\.0|eupl-1\.[012]|efl-[12]\.0|cecill-(?:1\.[01]|2\.[01]|b|c)|lppl-1\.[0-3][ac]?|ofl-1\.[01](?:-no-rfn|-rfn)?|php-3\.0[1]?|zpl-[12]\.[01]|nposl-3\.0|ngpl"
    r"|(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+"
)
NAME = re.compile(rf"(?:{'|'.join(map(re.escape, NAMES.split()))}|{FAMILIES})\+?")
EXCEPTION = re.compile(r"[a-z0-9.-]*exception(?:-[a-z0-9.-]+)?|linux-syscall-note|additionref-[a-z0-9.-]+")
STRENGTH = {"with": 3, "and": 2, "or": 1}
RESULT = "key long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions string, places string"


def postfix(text: str, at: int = 0, end: int | None = None) -> list[str]:
    """The longest readable head of the licence expression in text[at:end] in postfix order; empty if there is none.

    Shunting yard: names go to the output, operators wait on a stack while a stronger or equal one is before them. A
    word that is no licence's name, or behind with no exception's, ends the expression before it."""
    out: list[str] = []
    waiting: list[str] = []
    best, depth, before, end = (0, 0), 0, "", len(text) if end is None else end
    while m := TOKEN.match(text, at, end):
        token = m[1] or m[2]
        wants_name = before in STRENGTH or before in ("", "(")
        if token == "(":
            if not wants_name or before == "with":
                break
            waiting.append(token)
            depth += 1
        elif token == ")":
            if wants_name or not depth:
                break
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
            depth -= 1
        elif token in STRENGTH:
            if wants_name or token == "with" and (before == ")" or waiting[-1:] == ["with"]):
                break
            while waiting and waiting[-1] != "(" and STRENGTH[waiting[-1]] >= STRENGTH[token]:
                out.append(waiting.pop())
            waiting.append(token)
        else:
            if not wants_name or not (EXCEPTION if before == "with" else NAME).fullmatch(token):
                break
            out.append(token)
        before, at = token, m.end()
        if not depth and before not in STRENGTH:
            best, rest = (len(out), len(waiting)), waiting[::-1]
    return [*out[: best[0]], *rest] if best[0] else []


def evaluate(order: list[str], value) -> bool:
    """Whether an expression in postfix order holds, where value tells it of a licence's name; an exception widens a licence and takes nothing from it."""
    stack: list = []
    for token in order:
        if token not in STRENGTH:
            stack.append(token)
            continue
        b, a = stack.pop(), stack.pop()
        if token == "with":
            stack.append(a)
        else:
            a, b = (value(x) if isinstance(x, str) else x for x in (a, b))
            stack.append(a and b if token == "and" else a or b)
    return bool(stack) and (value(stack[0]) if isinstance(stack[0], str) else stack[0])


def written(order: list[str]) -> str:
    """An expression in postfix order as one line in its own form, with the brackets it needs: exact, and no longer than the expression."""
    stack: list = []
    for token in order:
        b, a = (stack.pop(), stack.pop()) if token in STRENGTH else (None, None)
        stack.append((token, a, b) if token in STRENGTH else token)
    out, todo = [], stack[:1]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        for side in (2, 1):
            loose = not isinstance(x[side], str) and STRENGTH[x[side][0]] < STRENGTH[x[0]]
            todo += [")", x[side], "("] if loose else [x[side]]
            todo += [x[0]] if side == 2 else []
    return " ".join(out).replace("( ", "(").replace(" )", ")")


def licences(order: list[str]) -> set[str]:
    """The labels of an expression: its licences, and each with its exception."""
    out, exception = set(), {i - 1 for i, t in enumerate(order) if t == "with"}
    for i, t in enumerate(order):
        if t not in STRENGTH and i not in exception:
            out.add(f"{t} with {order[i + 1]}" if i + 1 in exception else t)
    return out


def automaton():
    """(finder of the phrases and the tag among words, finder of tags in a text as it stands)."""
    import ahocorasick

    made, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase, label in BASE.items():
        made.add_word(f" {phrase} ", (phrase, label, None, BASE_WEIGHT))
    for phrase, (label, weight) in MORE.items():
        made.add_word(f" {phrase} ", (phrase, None, label, weight))
    made.add_word(f" {TAG} ", (TAG, None, None, 0.0))
    made.make_automaton()
    for tag in TAGS:
        tags.add_word(tag, len(tag))
    tags.make_automaton()
    return made, tags


def expressions_in(low: str, tags) -> list[list[str]]:
    """The readable expressions behind a text's tags, in postfix order; each ends with its line, or at the next tag."""
    places = [(last + 1 - n, last + 1) for last, n in tags.iter(low)]
    places = [(a, b) for a, b in places if (not a or NOT_WORD.match(low[a - 1])) and NOT_WORD.match(low[b : b + 1] or " ")]
    out = []
    for i, (_, behind) in enumerate(places):
        until = places[i + 1][0] if i + 1 < len(places) else len(low)
        if order := postfix(low, BEHIND_TAG.match(low, behind).end(), until):
            out.append(order)
    return out


def scan(text: str | None, finders) -> tuple:
    """RESULT without the key, of one text."""
    finder, tags = finders
    low = (text or "").encode().lower().decode()  # bytes lower ASCII letters only
    line = f" {NOT_WORD.sub(' ', low).strip(' ')} "
    n_words = line.count(" ") - 1 if len(line) > 2 else 0
    found = [(end - len(f[0]) - 1, *f) for end, f in finder.iter(line)] if n_words else []
    if not found:
        return n_words, 0, None, None, "", "", 0.0, "", ""
    blanks = [i for i, c in enumerate(line) if c == " "]
    base, own, labels, missing, expressions, places = [], set(), set(), 1.0, [], []
    longest = {}
    for start, phrase, *_ in found:
        longest[start] = max(longest.get(start, 0), len(phrase))
    for start, phrase, base_label, label, weight in found:
        word = bisect_right(blanks, start) - 1
        if base_label:
            base.append(word)
            own.add(base_label)
        if phrase == TAG or label and len(phrase) < longest[start]:
            continue  # a tag, or the head of a longer phrase
        if label:
            labels.add(label)
        missing *= 1 - weight
        places.append(f"{base_label or label}:{word}:{word + phrase.count(' ') + 1}")
    if any(f[1] == TAG for f in found):
        for order in expressions_in(low, tags):
            expressions.append(written(order))
            labels |= licences(order)
            missing *= 1 - TAG_WEIGHT
    return (
        n_words, len(base), min(base, default=None), max(base, default=None), ",".join(sorted(own)), ",".join(sorted(own | labels)),
        1 - missing, "; ".join(expressions), ",".join(places),
    )


def _scanner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    finders = automaton()
    kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), pa.string(), pa.string()]
    for b in batches:
        rows = [scan(t.as_py(), finders) for t in b.column(1)]
        columns = [b.column(0), *(pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * 9, kinds))]
        yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in RESULT.split(", ")])


def scan_licenses(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """RESULT of every document, in one pass without a shuffle. places: label:first word:end word of every phrase found."""
    ship(docs.sparkSession)
    own = docs.select(F.col(named(key)).cast("long").alias("key"), F.col(named(text)).cast("string").alias("text"))
    return own.mapInArrow(_scanner, RESULT)


def op8_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document."""
    return scan_licenses(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")
