"""License scans: ordered signature rules over the words of a text, DataFrame functions only.

A text becomes its words (runs of letters, digits and non-ASCII characters, A-Z
lower-cased).  A keyword prefilter lets through the few texts that can hold a
license at all.  In those, each word that begins a rule opens a window of
WINDOW words, on which the regexes of that word's rules are tried; a match is a
detection (rule, label, priority, first word, end).  A detection that lies within
another one of better priority, or of equal priority and greater length, is
suppressed.  Work per word is bounded, so time is linear in the text.

Besides the rules there are base phrases, whose places are counted everywhere
and whose labels always stay.  Null texts count as empty, texts without words
have no detection, repeated rows are scanned alike.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import reserved

#: Words of the longest signature that is looked for.
WINDOW = 16

#: Phrases whose labels always stay.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Fixed values, one license a line: label, its name as a regex over words, and
#: the words of its short identifier.
LICENSES = [
    ("mit", r"(?:mit|expat)(?: x11)? licen[cs]e", "mit"),
    ("mit-0", r"mit no attribution(?: licen[cs]e)?", "mit 0"),
    ("x11", r"x11 licen[cs]e", "x11"),
    ("isc", r"isc licen[cs]e", "isc"),
    ("apache-1.1", r"apache(?: software)? licen[cs]e(?: version| v)? ?1 1", "apache 1 1"),
    ("apache-2.0", r"apache(?: software)? licen[cs]e(?: version| v)? ?v?2(?: 0)?", "apache 2 0"),
    ("bsd-2-clause", r"(?:simplified bsd|bsd 2 clause|2 clause bsd)(?: licen[cs]e)?", "bsd 2 clause"),
    ("bsd-3-clause", r"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd)(?: licen[cs]e)?", "bsd 3 clause"),
    ("bsd-4-clause", r"(?:original bsd|bsd 4 clause|4 clause bsd)(?: licen[cs]e)?", "bsd 4 clause"),
    ("0bsd", r"zero clause bsd(?: licen[cs]e)?", "0bsd"),
    ("gpl-1.0", r"(?:gnu )?(?:general public licen[cs]e|gpl)(?: version| v)? ?v?1(?: 0)?", "gpl 1 0"),
    ("gpl-2.0", r"(?:gnu )?(?:general public licen[cs]e|gpl)(?: version| v)? ?v?2(?: 0)?", "gpl 2 0"),
    ("gpl-3.0", r"(?:gnu )?(?:general public licen[cs]e|gpl)(?: version| v)? ?v?3(?: 0)?", "gpl 3 0"),
    ("lgpl-2.0", r"(?:gnu )?(?:library general public licen[cs]e|lgpl)(?: version| v)? ?v?2(?: 0)?", "lgpl 2 0"),
    ("lgpl-2.1", r"(?:gnu )?(?:lesser general public licen[cs]e|lgpl)(?: version| v)? ?v?2 1", "lgpl 2 1"),
    ("lgpl-3.0", r"(?:gnu )?(?:lesser general public licen[cs]e|lgpl)(?: version| v)? ?v?3(?: 0)?", "lgpl 3 0"),
    ("agpl-3.0", r"(?:gnu )?(?:affero general public licen[cs]e|agpl)(?: version| v)? ?v?3(?: 0)?", "agpl 3 0"),
    ("gfdl-1.3", r"(?:gnu )?free documentation licen[cs]e(?: version| v)? ?1 3", "gfdl 1 3"),
    ("mpl-1.1", r"(?:mozilla public licen[cs]e|mpl)(?: version| v)? ?1 1", "mpl 1 1"),
    ("mpl-2.0", r"(?:mozilla public licen[cs]e|mpl)(?: version| v)? ?2 0", "mpl 2 0"),
    ("epl-1.0", r"(?:eclipse public licen[cs]e|epl)(?: version| v)? ?1 0", "epl 1 0"),
    ("epl-2.0", r"(?:eclipse public licen[cs]e|epl)(?: version| v)? ?2 0", "epl 2 0"),
    ("cddl-1.0", r"(?:common development and distribution licen[cs]e|cddl)(?: version| v)? ?1 0", "cddl 1 0"),
    ("cpl-1.0", r"common public licen[cs]e(?: version| v)? ?1 0", "cpl 1 0"),
    ("eupl-1.2", r"(?:european union public licen[cs]e|eupl)(?: version| v)? ?1 2", "eupl 1 2"),
    ("artistic-1.0", r"artistic licen[cs]e(?: version| v)? ?1 0", "artistic 1 0"),
    ("artistic-2.0", r"artistic licen[cs]e(?: version| v)? ?2 0", "artistic 2 0"),
    ("bsl-1.0", r"boost software licen[cs]e(?: version| v)? ?1 0", "bsl 1 0"),
    ("zlib", r"zlib(?: libpng)? licen[cs]e", "zlib"),
    ("unlicense", r"the unlicense", "unlicense"),
    ("wtfpl", r"do what the fuck you want to public licen[cs]e", "wtfpl"),
    ("postgresql", r"postgresql licen[cs]e", "postgresql"),
    ("python-2.0", r"python(?: software foundation)? licen[cs]e(?: version| v)? ?2", "psf 2 0"),
    ("openssl", r"openssl licen[cs]e", "openssl"),
    ("ofl-1.1", r"sil open font licen[cs]e(?: version| v)? ?1 1", "ofl 1 1"),
    ("odbl-1.0", r"open(?: data commons)? open database licen[cs]e", "odbl 1 0"),
    ("cc0-1.0", r"(?:creative commons zero|cc0)(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("cc-by-3.0", r"(?:creative commons attribution|cc by)(?: international| unported)? 3 0", "cc by 3 0"),
    ("cc-by-4.0", r"(?:creative commons attribution|cc by)(?: international)? 4 0", "cc by 4 0"),
    ("cc-by-sa-3.0", r"(?:creative commons attribution share ?alike|cc by sa)(?: international| unported)? 3 0", "cc by sa 3 0"),
    ("cc-by-sa-4.0", r"(?:creative commons attribution share ?alike|cc by sa)(?: international)? 4 0", "cc by sa 4 0"),
    ("cc-by-nc-4.0", r"(?:creative commons attribution non ?commercial|cc by nc)(?: international)? 4 0", "cc by nc 4 0"),
    ("cc-by-nd-4.0", r"(?:creative commons attribution no ?derivatives|cc by nd)(?: international)? 4 0", "cc by nd 4 0"),
    ("cc-by-nc-sa-4.0", r"(?:creative commons attribution non ?commercial share ?alike|cc by nc sa)(?: international)? 4 0", "cc by nc sa 4 0"),
    ("ms-pl", r"microsoft public licen[cs]e", "ms pl"),
    ("busl-1.1", r"business source licen[cs]e(?: version| v)? ?1 1", "busl 1 1"),
    ("elastic-2.0", r"elastic licen[cs]e(?: version| v)? ?2 0", "elastic 2 0"),
    ("sspl-1.0", r"server side public licen[cs]e", "sspl 1 0"),
]

#: Signatures that name a kind of terms rather than one license.
GENERAL = [
    ("gpl", r"(?:gnu )?general public licen[cs]e", 4),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public licen[cs]e", 4),
    ("agpl", r"(?:gnu )?affero general public licen[cs]e", 4),
    ("apache", r"apache(?: software)? licen[cs]e", 4),
    ("bsd", r"bsd(?: style)? licen[cs]e", 4),
    ("creative-commons", r"creative commons(?: licen[cs]e)?", 4),
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", 2),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", 2),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose", 2),
    ("zlib", r"this software is provided as is without any express or implied warranty", 3),
    ("public-domain", r"(?:released|dedicated|placed) (?:to|into|in) the public domain", 3),
    ("public-domain", r"this (?:work|file|software|text) is in the public domain", 3),
    ("proprietary", r"all rights reserved", 5),
    ("proprietary", r"proprietary and confidential", 4),
]

#: Confidence of a detection by its priority; 1 is the best.
CONFIDENCE = {1: 1.0, 2: 0.95, 3: 0.9, 4: 0.75, 5: 0.5}
BASE_CONFIDENCE = 0.9

#: Words that most signatures hold; matched on words joined by one space.  ``gate``
#: adds what the other signatures begin with.
KEYWORDS = r"(?i)licen[cs]e|copyleft|public domain|creative commons|\bcc(?: by|0)|\b[al]?gpl|\bbsd|no attribution|rights reserved|proprietary and|permission (?:is|to)|redistribution and|provided as is"


@dataclass(frozen=True)
class Rule:
    rule: str
    label: str
    priority: int
    pattern: str
    first: tuple[str, ...]


def examples(pattern: str) -> list[str]:
    """All texts that a signature matches; it may hold letters, [ab], (?:a|b c) and ?."""

    def options(i: int) -> tuple[list[str], int]:
        out, here = [], [""]
        while i < len(pattern) and pattern[i] != ")":
            if pattern[i] == "|":
                out, here, i = out + here, [""], i + 1
                continue
            if pattern.startswith("(?:", i):
                unit, i = options(i + 3)
                i += 1
            elif pattern[i] == "[":
                end = pattern.index("]", i)
                unit, i = list(pattern[i + 1 : end]), end + 1
            else:
                unit, i = [pattern[i]], i + 1
            if pattern[i : i + 1] == "?":
                unit, i = ["", *unit], i + 1
            here = [x + y for x in here for y in unit]
        return out + here, i

    return options(0)[0]


def _first_words(pattern: str) -> tuple[str, ...]:
    """The words a signature can begin with, joined forms as gplv3 included."""
    return tuple(sorted({x.split(" ")[0] for x in examples(pattern)}))


@lru_cache(maxsize=1)
def gate() -> str:
    """A text that this doesn't match holds none of the rules' signatures: KEYWORDS, and
    the first two words of each signature, shortest first, that holds none so far."""
    known, added = re.compile(KEYWORDS), {}
    for text in sorted({x for _, name, _ in LICENSES for x in examples(name)} | {x for _, form, _ in GENERAL for x in examples(form)}, key=lambda x: (len(x), x)):
        if not known.search(text) and not any(f" {x}" in f" {text}" for x in added):
            added[" ".join(text.split(" ")[:2])] = None
    return "|".join([KEYWORDS, *(rf"\b{x}" for x in added)])


def rules() -> list[Rule]:
    """All rules: five signatures for each license, then the general ones.

    Each holds the word license, a license's name or a general signature, as ``gate`` expects.
    """
    out = []
    for label, name, short in LICENSES:
        forms = (
            (1, f"spdx licen[cs]e identifier {short}(?: only| or later)?", ("spdx",)),
            (2, rf"(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?(?:{name})", ("licensed", "released", "distributed", "available", "published", "provided")),
            (2, rf"licen[cs]e (?:is )?(?:the )?(?:{name})", ("license", "licence")),
            (3, rf"(?:{name})", _first_words(name)),
            (4, rf"licen[cs]e {short}", ("license", "licence")),
        )
        out += [Rule(f"{label}/{k}", label, priority, f"^(?:{form})(?= |$)", first) for k, (priority, form, first) in enumerate(forms)]
    out += [Rule(f"general/{k}", label, priority, f"^(?:{form})(?= |$)", _first_words(form)) for k, (label, form, priority) in enumerate(GENERAL)]
    return out


def longest(table: list[Rule]) -> int:
    """Words of the longest text that a rule can match, at most; ValueError if it has no bound."""
    for rule in table:
        if re.search(r"[*+{]", rule.pattern):
            raise ValueError(f"{rule.rule}: a signature without repetitions is needed")
    return max((rule.pattern.count(" ") + 1 for rule in table), default=1)


_KIND = "array<struct<rule:string,label:string,priority:int,pattern:string>>"


def _by_first_word(table: list[Rule]) -> dict[str, list[dict]]:
    out: dict[str, list[dict]] = {}
    for rule in table:
        for word in rule.first:
            out.setdefault(word, []).append({k: v for k, v in asdict(rule).items() if k != "first"})
    return out


def words_joined(text: Column) -> Column:
    """A text's words, case kept, joined by single spaces."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "))


def _n_words(joined: Column) -> Column:
    return F.when(joined == "", 0).otherwise(F.length(joined) - F.length(F.replace(joined, F.lit(" "), F.lit(""))) + 1).cast("bigint")


def _places(words: Column, phrase: str) -> Column:
    """Start words of a phrase's places."""
    parts = phrase.split(" ")

    def here(i: Column) -> Column:
        out = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            out = out & (F.get(words, i + k) == part)
        return F.coalesce(out, F.lit(False))

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)


def scan(docs: DataFrame, keep: list[str], text: str = "text", table: list[Rule] | None = None) -> DataFrame:
    """docs' columns ``keep`` plus: n_words; base (array of phrase label, start
    word); detections (array of the rules' kept detections: start, end, priority,
    rule, label); labels (array, distinct and sorted); score.

    A map over the scan: no shuffle.
    """
    by_word = _by_first_word(rules() if table is None else table)
    window_words = WINDOW if table is None else longest(table)
    keywords = gate() if table is None else "|".join([KEYWORDS, *(rf"\b{re.escape(x)}" for x in by_word)])
    most = max(map(len, by_word.values()), default=1)
    lookup = F.from_json(F.lit(json.dumps(by_word)), f"map<string,{_KIND}>")
    letters = "abcdefghijklmnopqrstuvwxyz"
    reserved(keep, "__joined", "__words", "__found", "n_words", "base", "detections", "labels", "score")
    df = docs.select(*keep, words_joined(F.col(text)).alias("__joined"))
    gated = F.when(F.col("__joined").rlike(keywords), F.split(F.translate("__joined", letters.upper(), letters), " "))
    df = df.select(*keep, _n_words(F.col("__joined")).alias("n_words"), gated.alias("__words"))
    words = F.col("__words")
    none = F.array().cast("array<struct<label:string,start:int>>")
    def places(phrase: str, label: str) -> Column:
        return F.transform(_places(words, phrase), lambda i: F.struct(F.lit(label).alias("label"), i.alias("start")))

    base = F.concat(*[places(*x) for x in BASE_PHRASES.items()])

    def found_at(i: Column) -> Column:
        window = F.array_join(F.slice(words, i + 1, window_words), " ")
        fits = F.filter(F.element_at(lookup, F.get(words, i)), lambda r: F.regexp_like(window, r["pattern"]))

        def detection(r: Column) -> Column:
            match = F.call_function("regexp_extract", window, r["pattern"], F.lit(0))
            end = i + F.length(match) - F.length(F.replace(match, F.lit(" "), F.lit(""))) + 1
            return F.struct(i.alias("start"), (-end).alias("minus_end"), r["priority"].alias("priority"), r["rule"].alias("rule"), r["label"].alias("label"))

        return F.transform(fits, detection)

    opens = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.array_contains(F.lit(sorted(by_word)), F.get(words, i)))
    found = F.array_sort(F.flatten(F.transform(opens, found_at)))
    df = df.select("*", F.when(words.isNotNull(), found).alias("__found"), F.coalesce(base, none).alias("base"))
    found = F.col("__found")

    def rank(d: Column) -> Column:
        return F.struct(d["priority"], d["start"] + d["minus_end"], d["rule"])

    def alone(d: Column, i: Column) -> Column:
        # What can contain d starts at most window_words words before it, or equals it.
        near = F.slice(found, F.greatest(F.lit(1), i + 1 - window_words * most), F.lit(window_words * most + most))
        inside = lambda e: (e["start"] <= d["start"]) & (e["minus_end"] <= d["minus_end"]) & (rank(e) < rank(d))
        return ~F.exists(near, inside)

    kept = F.transform(F.filter(found, alone), lambda d: F.struct(d["start"], (-d["minus_end"]).alias("end"), d["priority"], d["rule"], d["label"]))
    empty = F.array().cast("array<struct<start:int,end:int,priority:int,rule:string,label:string>>")
    df = df.select(*keep, "n_words", "base", F.coalesce(kept, empty).alias("detections"))
    confidence = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])
    labels = F.array_sort(F.array_distinct(F.concat(F.transform("base", lambda b: b["label"]), F.transform("detections", lambda d: d["label"]))))
    best = F.array_max(F.transform("detections", lambda d: F.element_at(confidence, d["priority"])))
    score = F.greatest(F.coalesce(best, F.lit(0.0)), F.when(F.size("base") > 0, BASE_CONFIDENCE).otherwise(0.0))
    return df.select("*", labels.alias("labels"), score.alias("score"))
