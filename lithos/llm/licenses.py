"""License scans with ordered signature rules, in DataFrame functions only.

Texts are normalised to words parted by single blanks, A-Z lower-cased where
they are searched. A rule is a
keyword, a regular expression over that form, a label and a priority. A text is
searched only if it holds some rule's keyword, and by a rule only if it holds
that rule's. Of detections that overlap by containment, one inside another
gives way: to the higher priority, or between equals to the longer. Everything
is one projection over the scan: no shuffle, no join and no Python.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import written

#: Fixed phrases and their labels; a place counts wherever a phrase's words stand consecutively.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: What separates words: ASCII but for letters and digits.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Hand-written names of licenses: label, keyword, name (a regular expression over normalised words).
# Priorities: 3 for a version stated, 2 for a family with a mark of its own, 1 for a bare family.
_NAMES: list[tuple[str, str, str, int]] = [
    ("mit", " mit", r"(?:the )?mit(?: expat)?", 2),
    ("apache-1.1", "apache", r"(?:the )?apache(?: software)? (?:license )?(?:version )?1 1", 3),
    ("apache-2", "apache", r"(?:the )?apache(?: software)? (?:license )?(?:version |v)?2(?: 0)?", 3),
    ("gpl-2", "gpl", r"(?:the )?(?:gnu )?gpl (?:version |v)?2(?: 0)?", 3),
    ("gpl-2", "general public", r"(?:the )?(?:gnu )?general public license (?:as published by the free software foundation )?(?:either )?(?:version |v)2(?: 0)?", 3),
    ("gpl-3", "gpl", r"(?:the )?(?:gnu )?gpl (?:version |v)?3(?: 0)?", 3),
    ("gpl-3", "general public", r"(?:the )?(?:gnu )?general public license (?:as published by the free software foundation )?(?:either )?(?:version |v)3(?: 0)?", 3),
    ("gpl", "gnu", r"(?:the )?gnu (?:gpl|general public license)", 1),
    ("lgpl-2", "library general", r"(?:the )?(?:gnu )?library general public license (?:version |v)?2(?: 0)?", 3),
    ("lgpl-2.1", "lgpl", r"(?:the )?(?:gnu )?lgpl (?:version |v)?2 1", 3),
    ("lgpl-2.1", "lesser general", r"(?:the )?(?:gnu )?lesser general public license (?:version |v)?2 1", 3),
    ("lgpl-3", "lgpl", r"(?:the )?(?:gnu )?lgpl (?:version |v)?3(?: 0)?", 3),
    ("lgpl-3", "lesser general", r"(?:the )?(?:gnu )?lesser general public license (?:version |v)?3(?: 0)?", 3),
    ("agpl-3", "agpl", r"(?:the )?(?:gnu )?agpl (?:version |v)?3(?: 0)?", 3),
    ("agpl-3", "affero", r"(?:the )?(?:gnu )?affero general public license (?:version |v)?3(?: 0)?", 3),
    ("bsd-2-clause", "bsd", r"(?:the )?(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)", 3),
    ("bsd-3-clause", "bsd", r"(?:the )?(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)", 3),
    ("bsd-4-clause", "bsd", r"(?:the )?(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)", 3),
    ("0bsd", "bsd", r"(?:the )?(?:0bsd|zero clause bsd|bsd zero clause)", 3),
    ("bsd", "bsd", r"(?:the )?bsd(?: style)?", 1),
    ("isc", " isc", r"(?:the )?isc", 2),
    ("mpl-1.1", "mozilla", r"(?:the )?mozilla public license (?:version |v)?1 1", 3),
    ("mpl-2", "mozilla", r"(?:the )?mozilla public license (?:version |v)?2(?: 0)?", 3),
    ("mpl-2", "mpl", r"(?:the )?mpl (?:version |v)?2(?: 0)?", 3),
    ("epl-1", "eclipse", r"(?:the )?eclipse public license (?:version |v)?1(?: 0)?", 3),
    ("epl-2", "eclipse", r"(?:the )?eclipse public license (?:version |v)?2(?: 0)?", 3),
    ("cddl-1", "cddl", r"(?:the )?cddl(?: (?:version |v)?1 ?[01]?)?", 2),
    ("cddl-1", "common development", r"(?:the )?common development and distribution license", 2),
    ("cpl-1", "common public", r"(?:the )?common public license(?: (?:version |v)?1(?: 0)?)?", 2),
    ("eupl-1.2", "eupl", r"(?:the )?eupl(?: (?:version |v)?1 2)?", 2),
    ("eupl-1.2", "european union public", r"(?:the )?european union public licen[cs]e(?: (?:version |v)?1 2)?", 2),
    ("artistic-1", "artistic", r"(?:the )?(?:perl )?artistic license(?: (?:version |v)?1(?: 0)?)?", 2),
    ("artistic-2", "artistic", r"(?:the )?artistic license (?:version |v)?2(?: 0)?", 3),
    ("bsl-1", "boost", r"(?:the )?boost software license(?: (?:version |v)?1(?: 0)?)?", 2),
    ("zlib", "zlib", r"(?:the )?zlib(?: libpng)?", 2),
    ("unlicense", "unlicense", r"(?:the )?unlicense", 2),
    ("wtfpl", "wtfpl", r"(?:the )?wtfpl", 2),
    ("ms-pl", "microsoft public", r"(?:the )?microsoft public license", 2),
    ("ms-rl", "microsoft reciprocal", r"(?:the )?microsoft reciprocal license", 2),
    ("postgresql", "postgresql", r"(?:the )?postgresql", 2),
    ("python-2", "python", r"(?:the )?python software foundation license(?: (?:version |v)?2)?", 2),
    ("php-3", "php", r"(?:the )?php license(?: (?:version |v)?3 ?0?1?)?", 2),
    ("ofl-1.1", "sil open font", r"(?:the )?sil open font license(?: (?:version |v)?1 1)?", 2),
    ("odbl-1", "open database", r"(?:the )?open database license(?: (?:version |v)?1(?: 0)?)?", 2),
    ("fdl-1.3", "free documentation", r"(?:the )?(?:gnu )?free documentation license(?: (?:version |v)?1 3)?", 2),
    ("cc0", "cc0", r"(?:the )?cc0(?: 1 0)?(?: universal)?", 3),
    ("cc-by", "cc by", r"(?:the )?cc by(?: [1-4] [05])?", 1),
    ("cc-by-sa", "cc by sa", r"(?:the )?cc by sa(?: [1-4] [05])?", 2),
    ("cc-by-nd", "cc by nd", r"(?:the )?cc by nd(?: [1-4] [05])?", 2),
    ("cc-by-nc", "cc by nc", r"(?:the )?cc by nc(?: [1-4] [05])?", 2),
    ("cc-by-nc-sa", "cc by nc sa", r"(?:the )?cc by nc sa(?: [1-4] [05])?", 3),
    ("cc-by-nc-nd", "cc by nc nd", r"(?:the )?cc by nc nd(?: [1-4] [05])?", 3),
    ("cc-by", "creative commons", r"(?:the |a )?creative commons attribution(?: [1-4] [05])?(?: international| generic| unported)?", 1),
    ("cc-by-sa", "creative commons", r"(?:the |a )?creative commons attribution share ?alike(?: [1-4] [05])?(?: international| generic| unported)?", 2),
    ("cc-by-nd", "creative commons", r"(?:the |a )?creative commons attribution no ?deriv(?:ative|atives|s)(?: [1-4] [05])?", 2),
    ("cc-by-nc", "creative commons", r"(?:the |a )?creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| generic| unported)?", 2),
    ("cc-by-nc-sa", "creative commons", r"(?:the |a )?creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?", 3),
    ("cc-by-nc-nd", "creative commons", r"(?:the |a )?creative commons attribution non ?commercial no ?deriv(?:ative|atives|s)(?: [1-4] [05])?", 3),
]

# How a name is used: what every match holds, the form, what it adds to the name's priority, and how sure such a use is.
_FRAMES: list[tuple[str, str, int, float]] = [
    ("under", r"(?:re)?(?:licen[cs]ed|released|distributed|published|available|provided|covered|made available) (?:freely )?under(?: the terms of)?(?: version [0-9] of)? {name}(?: licen[cs]e)?", 30, 0.95),
    ("spdx license identifier", r"spdx license identifier {name}", 40, 1.0),
    ("licen", r"(?:subject to|governed by|under)(?: the terms(?: and conditions)? of)? {name} licen[cs]e", 20, 0.9),
    ("licen", r"{name} licen[cs]e", 10, 0.7),
    ("", r"{name}", 0, 0.5),
]

def rules() -> list[tuple[str, tuple[str, str], str, int, float]]:
    """(label, two keywords, regular expression, priority, strength), highest priority first: the written ones, and every name in every frame."""
    found = []
    for label, word, name, rank in _NAMES:
        for frame, form, priority, strength in _FRAMES:
            if not frame and rank < 3 and not word.startswith("cc by"):
                continue  # a bare family name alone says nothing
            if label == "mit" and priority == 20:
                form = form.replace(" {name}", "(?: the)? {name}")
            found.append((label, (word, frame), r"(?<![^ ])(?:" + form.format(name=name) + r")(?![^ ])", priority + rank, strength))
    found += [(label, (word, ""), r"(?<![^ ])(?:" + form + r")(?![^ ])", priority, strength) for label, word, form, priority, strength in written()]
    return sorted(found, key=lambda r: -r[3])


#: What says that a name is used as a license's; one of these is in every match of the frames other than a bare version.
_USES = ("licen", "spdx", "released under", "distributed under", "published under", "available under", "provided under", "covered under", "freely under")
#: A text without any of these strings holds no rule's match; keywords such as mit are common words elsewhere.
GATE = (
    *_USES, "apache", "gpl", "general public", "bsd", "mozilla", "mpl", "eclipse", "artistic", "cc0", "cc by", "creative commons", "creativecommons", "opensource org", "opendatacommons", "permission",
    "redistribut", "copyright", "public domain", "the software", "this software", "proprietary", "trade secret", "rights reserved", "warranty", "commercial use", "personal use", "use only", "unauthori", "may be reproduced", "non commercial",
    "noncommercial", "share alike", "sharealike", "unlicense", "wtfpl", "commons clause", "polyform", "as perl itself", "open rail", "openrail", "distribution", "a beer", "franklin st", "temple place", "waived all", "this product includes",
    "the contents of this file", "anyone is free", "source form", "source versions", "scripts sil org", "w3 org", "unicode org", "cecill", "property of", "what the fuck", "library general", "lesser general", "affero", "gnu org", "subject to version", "to endorse or promote", "fifth floor boston", "no attribution", "via any medium", "the authors", "without restriction", "university of illinois", "advertising", "official policies",
)


def ungated(found: list[tuple[str, tuple[str, str], str, int, float]]) -> list[str]:
    """Rules that the gate could miss: there must be none."""
    bare = {r"(?<![^ ])(?:" + name + r")(?![^ ])" for _, _, name, _ in _NAMES}
    own = {r"(?<![^ ])(?:" + form + r")(?![^ ])" for _, _, form, _, _ in written()}
    return [form for _, (word, _), form, _, _ in found if form in bare | own and not any(g in word for g in GATE)]


#: Stems that several strings of the gate share; where a stem is missing, these need not be looked for.
_STEMS = ("under", "general", "commons", " org", "commercial", "software", "permi", "apache", "public", "rights", "use only")


def _gate(low: Column) -> Column:
    """Whether a text in lower case may hold a match. Lower case of any letter is enough here, as all strings are ASCII."""
    strings = [g for g in (*GATE, *PHRASES) if not any(o in g for o in GATE if o != g)]
    groups: dict[str, list[str]] = {}
    for g in strings:
        groups.setdefault(next((x for x in _STEMS if x in g), g), []).append(g)
    out = F.lit(False)
    for stem, own in groups.items():
        any_ = F.lit(False)
        for g in own:
            if g != stem:
                any_ |= F.contains(low, F.lit(g))
        out |= F.contains(low, F.lit(stem)) & (F.lit(True) if stem in own else any_)
    return out


def normalised(text: Column) -> Column:
    """Words with single blanks between and around them, in their own case."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _GAP, " ")), F.lit(" "))


def lowered(words: Column) -> Column:
    """A-Z lower-cased; no other letter changes."""
    return F.translate(words, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _blanks(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def word_count(words: Column) -> Column:
    """Words of a normalised text: its blanks less one."""
    return F.when(F.length(words) <= 2, F.lit(0).cast("long")).otherwise(_blanks(words) - 1)


def _places(words: Column, phrase: str) -> Column:
    """Struct of the number of places where the phrase starts, and the first and last as word numbers."""
    # a place's last blank may be the next one's first, so every blank is doubled: no place hides another
    doubled = F.replace(words, F.lit(" "), F.lit("  "))
    parts = F.split(doubled, " " + phrase.replace(" ", "  ") + " ")
    count = F.size(parts) - 1
    # two blanks stand before each word, one of them in the place itself
    first = F.floor(_blanks(F.element_at(parts, 1)) / 2)
    last = F.floor((_blanks(doubled) - _blanks(F.element_at(parts, -1)) - 2 * len(phrase.split(" "))) / 2)
    return F.struct(count.cast("long").alias("n"), F.when(count > 0, first).alias("first"), F.when(count > 0, last).alias("last"))


_TABLE = "array<struct<part:string,rules:array<struct<label:string,word:string,with:string,form:string,priority:int,strength:double,level:int>>>>"


def _detections(words: Column, found: list[tuple[str, tuple[str, str], str, int, float]]) -> Column:
    """Array of ``_DETECTION``: character spans in the normalised text."""
    level = {p: n for n, p in enumerate(sorted({r[3] for r in found}))}
    groups: dict[str, list[dict]] = {}
    for label, (word, other), form, priority, strength in found:
        rule = {"label": label, "word": word, "with": other, "form": form, "priority": priority, "strength": strength, "level": level[priority]}
        groups.setdefault(next((g for g in (*GATE[1:], GATE[0]) if g in word), word), []).append(rule)  # licen, the commonest, last
    # a string that many keywords hold is looked for once; the table is one constant of the plan
    table = F.from_json(F.lit(json.dumps([{"part": g, "rules": own} for g, own in groups.items()])), _TABLE)
    near = F.filter(table, lambda g: F.contains(words, g["part"]))
    active = F.flatten(F.transform(near, lambda g: F.filter(g["rules"], lambda r: F.contains(words, r["word"]) & F.contains(words, r["with"]))))

    def spans(r: Column) -> Column:
        hits = F.regexp_extract_all(words, r["form"], F.lit(0))
        gaps = F.slice(F.split(words, r["form"]), F.lit(1), F.size(hits))
        start = lambda acc, x: acc["at"] + F.length(x["gap"])
        found_ = lambda acc, x: F.struct(
            start(acc, x).alias("start"), (-start(acc, x) - F.length(x["hit"])).alias("back"), (-r["level"]).alias("below"), r["label"].alias("label"), r["priority"].alias("priority"), r["strength"].alias("strength"),
        )
        walk = F.aggregate(
            F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_DETECTION}>").alias("out")),
            lambda acc, x: F.struct((start(acc, x) + F.length(x["hit"])).alias("at"), F.concat(acc["out"], F.array(found_(acc, x))).alias("out")),
        )
        return walk["out"]

    some = F.filter(active, lambda r: F.rlike(words, r["form"]))
    return F.flatten(F.transform(some, spans))


#: A detection as it is sorted: by start, then the longer, then the higher priority. ``back`` is its end, ``below`` its level, both negative.
_DETECTION = "struct<start:int,back:int,below:int,label:string,priority:int,strength:double>"


def _kept(all_: Column, levels: int) -> Column:
    """Detections that lie in no other one of higher priority, or of the same priority and longer.

    In order of their starts, whatever holds a detection comes before it, so for
    every level the furthest end so far, and the first start with that end,
    decide: one step for each detection.
    """
    none = F.struct(F.lit(-1).alias("end"), F.lit(-1).alias("start"))

    def step(acc: Column, d: Column) -> Column:
        level, end = -d["below"], -d["back"]
        own = F.element_at(acc["tops"], level + 1)
        above = F.exists(F.slice(acc["tops"], level + 2, F.lit(levels)), lambda t: t["end"] >= end)
        inside = above | (own["end"] > end) | ((own["end"] == end) & (own["start"] < d["start"]))
        tops = F.transform(acc["tops"], lambda t, i: F.when((i == level) & (t["end"] < end), F.struct(end.alias("end"), d["start"].alias("start"))).otherwise(t))
        kept = F.struct(d["label"].alias("label"), d["priority"].alias("priority"), d["strength"].alias("strength"), d["start"].alias("start"), end.alias("end"))
        return F.struct(tops.alias("tops"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], F.array(kept))).alias("out"))

    zero = F.struct(F.array_repeat(none, levels).alias("tops"), F.array().cast(f"array<{_KEPT}>").alias("out"))
    return F.aggregate(F.array_sort(all_), zero, step, lambda acc: acc["out"])


_KEPT = "struct<label:string,priority:int,strength:double,start:int,end:int>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's license detections.

    Returns doc_id, n_words, n_base (places of the fixed phrases), first_word
    and last_word (smallest and largest start of such a place, words from 0),
    base_labels, detections (label, priority, strength, start, end; spans in the
    normalised text), labels and score (the strongest detection; 1 for a fixed
    phrase, 0 without any).

    Null and empty texts have no words and no labels. Repeated rows, and null or
    repeated ids, are scanned row by row; an empty table gives no rows; other
    columns are ignored.
    """
    found = rules()
    words = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col).cast("string")).alias("w"))
    gate = _gate(F.col("low"))
    none = F.array().cast(f"array<{_KEPT}>")
    # a column of its own, as a branch would lower the text anew for each string
    words = words.select("doc_id", "w", F.lower("w").alias("low"))
    gated = words.select("doc_id", word_count(F.col("w")).alias("n_words"), F.when(gate, lowered(F.col("w"))).alias("w"))
    hits = F.when(F.col("w").isNotNull(), F.struct(*[_places(F.col("w"), p).alias(f"p{i}") for i, p in enumerate(PHRASES)], _kept_of(found).alias("detections")))
    rows = gated.select("doc_id", "n_words", hits.alias("h"))
    places = [F.col(f"h.p{i}") for i in range(len(PHRASES))]
    base = F.array_compact(F.array(*[F.when(p["n"] > 0, F.lit(label)) for p, label in zip(places, PHRASES.values(), strict=True)]))
    count = sum((F.coalesce(p["n"], F.lit(0)) for p in places), F.lit(0).cast("long"))
    detections = F.coalesce(F.col("h.detections"), none)
    return rows.select(
        "doc_id", "n_words", count.alias("n_base"), F.least(*[p["first"] for p in places]).alias("first_word"), F.greatest(*[p["last"] for p in places]).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"), detections.alias("detections"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, F.transform(detections, lambda d: d["label"])))), ",").alias("labels"),
        F.greatest(F.when(count > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform(detections, lambda d: d["strength"])), F.lit(0.0))).alias("score"),
    )


def _kept_of(found: list[tuple[str, tuple[str, str], str, int, float]]) -> Column:
    # one lambda binds the detections, so that they are found once
    levels = len({r[3] for r in found})
    return F.flatten(F.transform(F.array(_detections(F.col("w"), found)), lambda all_: _kept(all_, levels)))
