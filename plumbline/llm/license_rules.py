"""License scan by ordered signature rules.

A text is lower-cased (A-Z only) and reduced to words joined by single blanks. Every rule is a regex over those words
with keywords of which any match contains one, a tier and a rank (its place in ``rules()``). Texts without any gate word are
done at once; in the others a rule runs only if one of its keywords occurs. Overlaps are resolved per text: a detection goes if
its interval lies inside that of a detection of the same or a better tier (of equal intervals the better rank stays).
Everything happens inside the row, so nothing is shuffled and no common license can become a hot key.

Defined cases: a null or wordless text has no detection, score 0 and null positions; repeated rows are scanned alike; extra
columns are kept, columns that carry a name of the result are replaced by it.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

# Fixed phrases that always count, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Names by label, as they read once text is reduced to words: regex of the name, and literals of which it contains one.
NAMES: list[tuple[str, str, str]] = [
    ("mit", "(?:mit|expat|x11)", "mit|expat|x11"),
    ("apache-2", "apache(?: software)?(?: license)?(?: version)?(?: v)? ?v?2(?: 0)?", "apache"),
    ("apache-1.1", "apache(?: software)?(?: license)?(?: version)? v?1 1", "apache"),
    ("apache", "apache(?: software)?", "apache"),
    ("gpl-2", "(?:gnu )?(?:general public license|gpl)(?: version)?(?: v)? ?v?2(?: 0)?", "general public|gpl"),
    ("gpl-3", "(?:gnu )?(?:general public license|gpl)(?: version)?(?: v)? ?v?3(?: 0)?", "general public|gpl"),
    ("gpl", "(?:gnu )?(?:general public|gpl)", "general public|gpl"),
    ("lgpl-2.1", "(?:gnu )?(?:lesser general public license|lgpl)(?: version)?(?: v)? ?v?2 1", "lesser general public|lgpl"),
    ("lgpl-3", "(?:gnu )?(?:lesser general public license|lgpl)(?: version)?(?: v)? ?v?3(?: 0)?", "lesser general public|lgpl"),
    ("lgpl", "(?:gnu )?(?:lesser general public|library general public|lgpl)", "lesser general public|library general public|lgpl"),
    ("agpl-3", "(?:gnu )?(?:affero general public license|agpl)(?: version)?(?: v)? ?v?3(?: 0)?", "affero general public|agpl"),
    ("agpl", "(?:gnu )?(?:affero general public|agpl)", "affero general public|agpl"),
    ("fdl", "(?:gnu )?(?:free documentation|fdl)", "free documentation|fdl"),
    ("bsd-2", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)", "bsd"),
    ("bsd-3", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)", "bsd"),
    ("bsd-4", "(?:bsd 4 clause|4 clause bsd|original bsd)", "bsd"),
    ("0bsd", "(?:0bsd|zero clause bsd|bsd zero clause)", "bsd"),
    ("bsd", "bsd", "bsd"),
    ("mpl-1.1", "(?:mozilla public license|mpl)(?: version)?(?: v)? ?v?1 1", "mozilla public|mpl"),
    ("mpl-2", "(?:mozilla public license|mpl)(?: version)?(?: v)? ?v?2(?: 0)?", "mozilla public|mpl"),
    ("mpl", "(?:mozilla public|mpl)", "mozilla public|mpl"),
    ("epl-1", "(?:eclipse public license|epl)(?: version)?(?: v)? ?v?1(?: 0)?", "eclipse public|epl"),
    ("epl-2", "(?:eclipse public license|epl)(?: version)?(?: v)? ?v?2(?: 0)?", "eclipse public|epl"),
    ("epl", "(?:eclipse public|epl)", "eclipse public|epl"),
    ("eupl", "(?:european union public|eupl)", "european union public|eupl"),
    ("cddl", "(?:common development and distribution|cddl)", "common development|cddl"),
    ("cpl", "common public", "common public"),
    ("isc", "isc", "isc"),
    ("zlib", "zlib(?: libpng)?", "zlib"),
    ("boost", "(?:boost software|bsl 1 0)", "boost software|bsl 1 0"),
    ("artistic-2", "artistic(?: license)?(?: version)? 2(?: 0)?", "artistic"),
    ("artistic", "artistic", "artistic"),
    ("unlicense", "(?:the )?unlicense", "unlicense"),
    ("wtfpl", "(?:wtfpl|do what the fuck you want to public)", "wtfpl|do what the"),
    ("python", "(?:python software foundation|psf)", "python software|psf"),
    ("postgresql", "postgresql", "postgresql"),
    ("openssl", "openssl", "openssl"),
    ("ofl", "(?:sil open font|ofl)", "sil open font|ofl"),
    ("odbl", "(?:open database|odbl|odc odbl)", "open database|odbl"),
    ("cc0", "(?:cc0(?: 1 0)?|creative commons zero)", "cc0|creative commons zero"),
    ("cc-by-nc-nd", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:s|ative|atives))(?: [1-4] [05])?", "cc by nc nd|creative commons"),
    ("cc-by-nc-sa", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1-4] [05])?", "cc by nc sa|creative commons"),
    ("cc-by-nc", "(?:cc by nc|creative commons attribution non ?commercial)(?: [1-4] [05])?", "cc by nc|creative commons"),
    ("cc-by-nd", "(?:cc by nd|creative commons attribution no ?deriv(?:s|ative|atives))(?: [1-4] [05])?", "cc by nd|creative commons"),
    ("cc-by-sa", "(?:cc by sa|creative commons attribution share ?alike)(?: [1-4] [05])?", "cc by sa|creative commons"),
    ("cc-by", "(?:cc by|creative commons attribution)(?: [1-4] [05])?", "cc by|creative commons"),
]

# How a name is used: tier (1 best), regex around the name, a literal that the regex always contains.
USES: list[tuple[int, str, str]] = [
    (1, "spdx license identifier {name}", "spdx license identifier"),
    (1, "licensed (?:to you )?under (?:the )?(?:terms of (?:the )?)?{name}(?: licen[cs]e)?(?: agreement)?(?:(?: version)? v?[0-9](?: [0-9])?)?", "licensed"),
    (1, "(?:released|distributed|published|available|provided|covered|made available) under (?:the )?(?:terms of (?:the )?)?{name} licen[cs]e(?:(?: version)? v?[0-9](?: [0-9])?)?", "licen"),
    (2, "(?:terms|conditions|copy) of the {name} licen[cs]e", "licen"),
    (2, "{name} licen[cs]e(?:(?: version)? v?[0-9](?: [0-9])?)?", "licen"),
    (3, "licen[cs]e(?: is| type)? {name}", "licen"),
]

# Whole notices: tier, label, regex, literal. {y} stands for an optional year or span of years.
NOTICES: list[tuple[int, str, str, str]] = [
    (1, "mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted"),
    (1, "isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy"),
    (1, "bsd", "redistribution and use in source and binary forms with or without modification", "redistribution and use"),
    (1, "gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "this program is free software"),
    (1, "lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "this library is free software"),
    (1, "unlicense", "this is free and unencumbered software released into the public domain", "public domain"),
    (1, "cc-by", "https? creativecommons org licenses by [1-4] [05]", "creativecommons org"),
    (1, "cc-by-sa", "https? creativecommons org licenses by sa [1-4] [05]", "creativecommons org"),
    (1, "cc-by-nc", "https? creativecommons org licenses by nc [1-4] [05]", "creativecommons org"),
    (1, "cc-by-nd", "https? creativecommons org licenses by nd [1-4] [05]", "creativecommons org"),
    (1, "cc-by-nc-sa", "https? creativecommons org licenses by nc sa [1-4] [05]", "creativecommons org"),
    (1, "cc-by-nc-nd", "https? creativecommons org licenses by nc nd [1-4] [05]", "creativecommons org"),
    (1, "cc0", "https? creativecommons org publicdomain zero 1 0", "creativecommons org"),
    (1, "apache-2", "https? (?:www )?apache org licenses license 2 0", "apache org licenses"),
    (2, "cc-by-nc", "cc by nc(?: [1-4] [05])?", "cc by"),
    (2, "cc-by-sa", "cc by sa(?: [1-4] [05])?", "cc by"),
    (2, "cc-by-nd", "cc by nd(?: [1-4] [05])?", "cc by"),
    (2, "cc0", "cc0(?: 1 0)?", "cc0"),
    (3, "cc-by", "cc by(?: [1-4] [05])?", "cc by"),
    (2, "public-domain", "(?:released|dedicated|placed) (?:in|to|into) the public domain", "public domain"),
    (3, "proprietary", "all rights reserved", "all rights reserved"),
]
WEIGHT = {1: 1.0, 2: 0.8, 3: 0.5}
# Every rule's literal contains one of these, so a text without them has no detection.
GATES = (
    "licen", "cc by", "cc0", "public domain", "creativecommons org", "rights reserved", "permission is hereby granted",
    "permission to use copy", "redistribution and use", "is free software",
)
_RULE_TYPE = "array<struct<rank:int,tier:int,label:string,keywords:array<string>,literal:string,pattern:string>>"
_RESULT = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")


CHUNK = 256
_SPANS = "array<struct<s:int,ne:int,tier:int,rank:int,label:string>>"


def rules() -> list[dict]:
    """All rules in order of rank: notices, then every use of every name."""
    found = [(tier, label, "", literal, pattern) for tier, label, pattern, literal in NOTICES]
    found += [(tier, label, word, literal, use.format(name=name)) for tier, use, literal in USES for label, name, word in NAMES]
    return [
        {"rank": k, "tier": tier, "label": label, "keywords": word.split("|"), "literal": literal, "pattern": f"(?<= ){pattern}(?= )"}
        for k, (tier, label, word, literal, pattern) in enumerate(found)
    ]


def normal_form(text: Column) -> Column:
    """Words between single blanks, with one blank at either end; a lone blank when there is no word."""
    return F.regexp_replace(F.concat(F.lit(" "), F.translate(text, UPPER, LOWER), F.lit(" ")), NOT_WORD, " ")


def _places(words: Column, phrase: str) -> Column:
    """Word numbers, from 0, at which the phrase's words stand consecutively."""
    parts = phrase.split()
    starts = F.sequence(F.lit(0), F.size(words) - len(parts))
    return F.filter(starts, lambda i: reduce(lambda a, b: a & b, [F.get(words, i + k) == part for k, part in enumerate(parts)]))


def _spans(body: Column, rule: Column) -> Column:
    """Detections of one rule: the gaps between matches and the matches give the character offsets."""
    pieces = F.zip_with(
        F.split(body, rule["pattern"]),
        F.regexp_extract_all(body, rule["pattern"], F.lit(0)),
        lambda gap, match: F.struct(F.length(gap).alias("gap"), F.length(match).alias("match")),
    )
    none = F.array().cast(_SPANS)
    size = lambda x: F.coalesce(x["gap"], F.lit(0)) + F.coalesce(x["match"], F.lit(0))

    def step(acc, piece):
        s = acc["at"] + F.coalesce(piece["gap"], F.lit(0))
        e = s + F.coalesce(piece["match"], F.lit(0))
        found = F.struct(s.alias("s"), (-e).alias("ne"), rule["tier"].alias("tier"), rule["rank"].alias("rank"), rule["label"].alias("label"))
        out = F.when(piece["match"].isNotNull(), F.concat(acc["out"], F.array(found))).otherwise(acc["out"])
        return F.struct(e.alias("at"), out.alias("out"))

    def placed(chunks):
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        add = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        lengths = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + size(x)))
        starts = F.aggregate(lengths, begin, add, lambda acc: acc["out"])
        return F.flatten(F.zip_with(chunks, starts, lambda c, at: F.aggregate(c, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"])))

    return _let(pieces, lambda p: _let(_chunks(p), placed))


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _chunks(values: Column) -> Column:
    """An array in parts of CHUNK elements: appending to an array copies it, so long ones are put together from short ones."""
    last = F.floor((F.size(values) - 1) / CHUNK).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(values, c * CHUNK + 1, CHUNK))
    return F.when(F.size(values) > 0, cut).otherwise(F.filter(F.array(values), lambda x: F.lit(False)))


def _resolved(spans: Column) -> Column:
    """Without those that lie inside one of the same or a better tier; one pass over the spans by start and end."""
    none = F.array().cast(_SPANS)

    def reached(acc, x) -> list[Column]:
        return [F.when(x["tier"] <= t, F.greatest(acc[f"m{t}"], -x["ne"])).otherwise(acc[f"m{t}"]).alias(f"m{t}") for t in WEIGHT]

    def step(acc, x):
        reach = F.when(x["tier"] == 1, acc["m1"]).when(x["tier"] == 2, acc["m2"]).otherwise(acc["m3"])
        return F.struct(*reached(acc, x), F.when(reach >= -x["ne"], acc["out"]).otherwise(F.concat(acc["out"], F.array(x))).alias("out"))

    def kept(chunks):
        # How far each tier reaches at the end of every chunk, and from there at the begin of the next.
        nowhere = F.struct(*[F.lit(-1).alias(f"m{t}") for t in WEIGHT])
        ends = F.transform(chunks, lambda c: F.aggregate(c, nowhere, lambda acc, x: F.struct(*reached(acc, x))))
        farther = lambda acc, x: F.struct(*[F.greatest(acc["at"][f"m{t}"], x[f"m{t}"]).alias(f"m{t}") for t in WEIGHT])
        begin = F.struct(nowhere.alias("at"), F.filter(F.array(nowhere), lambda x: F.lit(False)).alias("out"))
        add = lambda acc, x: F.struct(farther(acc, x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        starts = F.aggregate(ends, begin, add, lambda acc: acc["out"])
        first = lambda at: F.struct(*[at[f"m{t}"].alias(f"m{t}") for t in WEIGHT], none.alias("out"))
        return F.flatten(F.zip_with(chunks, starts, lambda c, at: F.aggregate(c, first(at), step, lambda acc: acc["out"])))

    return _let(F.sort_array(spans), lambda x: _let(_chunks(x), kept))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with labels, base places, score and ``detections`` (offsets in the normal form, rule and label)."""
    taken = {*_RESULT, "body", "gate", "words", "spans", "kinds", "places", "base_set"}
    rows = docs.select(normal_form(text_of(text)).alias("body"), *[F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken])
    body = F.col("body")
    n_words = (F.length(body) - F.length(F.replace(body, F.lit(" "), F.lit(""))) - 1).cast("long")
    rows = rows.withColumn("n_words", n_words)
    table = F.from_json(F.lit(json.dumps(rules())), _RULE_TYPE)
    gate = reduce(lambda a, b: a | b, [F.contains(body, F.lit(g)) for g in GATES])
    eligible = F.filter(table, lambda r: F.contains(body, r["literal"]) & F.exists(r["keywords"], lambda k: F.contains(body, k)))
    spans = F.flatten(F.transform(eligible, lambda r: _spans(body, r)))
    holds = {phrase: F.contains(body, F.lit(f" {phrase} ")) for phrase in BASE}
    # A column of its own, so that no step per word splits the text again.
    rows = rows.withColumns({"gate": gate, "words": F.when(reduce(lambda a, b: a | b, holds.values()), F.split(F.trim(body), " "))})
    hits = F.array(
        *[F.struct(F.lit(label).alias("label"), F.when(holds[phrase], _places(F.col("words"), phrase)).alias("places")) for phrase, label in BASE.items()]
    )
    kinds = F.when(F.col("words").isNotNull(), F.filter(hits, lambda h: h["places"].isNotNull()))
    rows = rows.withColumns({"spans": F.when(F.col("gate"), spans), "kinds": kinds})
    rows = rows.withColumns(
        {
            "detections": F.transform(
                _resolved(F.coalesce(F.col("spans"), F.array().cast(_SPANS))),
                lambda x: F.struct(x["s"].alias("start"), (-x["ne"]).alias("end"), x["tier"].alias("tier"), x["rank"].alias("rank"), x["label"].alias("label")),
            ),
            "places": F.coalesce(F.flatten(F.transform("kinds", lambda h: h["places"])), F.array().cast("array<int>")),
            "base_set": F.coalesce(F.transform("kinds", lambda h: h["label"]), F.array().cast("array<string>")),
        }
    )
    best = F.array_min(F.transform("detections", lambda x: x["tier"]))
    score = reduce(lambda c, t: c.when(best == t, F.lit(WEIGHT[t])), WEIGHT, F.when(F.size("places") > 0, F.lit(1.0)))
    return rows.withColumns(
        {
            "n_base": F.size("places").cast("long"),
            "first_word": F.array_min("places").cast("long"),
            "last_word": F.array_max("places").cast("long"),
            "base_labels": F.array_join(F.sort_array(F.array_distinct("base_set")), ","),
            "labels": F.array_join(
                F.sort_array(F.array_distinct(F.concat("base_set", F.transform("detections", lambda x: x["label"])))), ","
            ),
            "score": score.otherwise(F.lit(0.0)),
        }
    ).drop("body", "gate", "words", "spans", "kinds", "places", "base_set")


def query(spark, sf_dir: str) -> DataFrame:
    """Registered query op2: licenses of all documents."""
    from plumbline.llm.common import table

    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[c for c in _RESULT if c != "detections"], F.size("detections").cast("long").alias("n_detections"))


def brute_force(text: str | None) -> tuple[list[tuple[int, int, str]], str]:
    """The same detections in plain Python, for tests: every rule on the text, every pair of detections compared."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    body = re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", low).strip(" ")
    body = f" {body} " if body else " "
    found = [(m.start(), m.end(), r["tier"], r["rank"], r["label"]) for r in rules() for m in re.finditer(r["pattern"], body)]

    def inside(a, b):
        if a == b or b[0] > a[0] or b[1] < a[1] or b[2] > a[2]:
            return False
        return (b[0], b[1]) != (a[0], a[1]) or (b[2], b[3]) < (a[2], a[3])

    kept = sorted(a for a in found if not any(inside(a, b) for b in found))
    labels = {x[4] for x in kept} | {label for phrase, label in BASE.items() if f" {phrase} " in body}
    return [(s, e, label) for s, e, _, _, label in kept], ",".join(sorted(labels))
