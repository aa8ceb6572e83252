"""License scans by ordered signature rules, in DataFrame functions alone.

A text becomes its lower-case words between single spaces. Rules are regular expressions over this
form, each with a keyword that stands as a word in whatever the rule matches; a rule is tried only on
texts that hold its keyword as a word, which loses nothing. Every match is a detection, an interval of words. A detection inside a longer one, or in an equal one of a rule
that stands earlier, is suppressed. Texts without any keyword, nearly all, meet no rule.

Rules come from families times versions times ways of writing, in order of priority: identifiers and
addresses first, full names with versions next, short names after these, then hints.

Defined results: null or empty texts have no words, no labels and score 0. Repeated rows are rows of
their own with equal results; null ids stay null. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str


def _versioned(name: str, versions: str, keyword: str, full: str, short: str) -> list[Rule]:
    """Rules of a family of licenses with versions: SPDX identifiers, full names and short names."""
    found = []
    for v in versions.split():
        spoken = " ".join(v.split("."))
        major = spoken.removesuffix(" 0")
        word, first = short.split()[0], short + major.split()[0]
        said = f"(?:version |v |v|ver )?{major}(?: 0)?" if spoken != major else f"(?:version |v |v)?{spoken}"
        found += [
            Rule(f"{name}-{v}-or-later", keyword, rf"{full} {said}(?: of the license)? or (?:at your option )?(?:any )?later(?: version)?"),
            Rule(f"{name}-{v}-or-later", "spdx", rf"spdx license identifier {short} {spoken} or later"),
            Rule(f"{name}-{v}", "spdx", rf"spdx license identifier {short} {spoken}(?: only)?"),
            Rule(f"{name}-{v}", keyword, rf"{full} {said}"),
            Rule(f"{name}-{v}", word, rf"{short} (?:v|version )?{spoken}|{short} v?{major}(?: only)?"),
            Rule(f"{name}-{v}", first, rf"{short}{major}(?: only)?"),
            Rule(f"{name}-{v}", first.replace(short, short + "v", 1), rf"{short}v{major}(?: only)?"),
        ]
    return found


def _commons() -> list[Rule]:
    words = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?"}
    found = []
    for parts in ("by nc sa", "by nc nd", "by sa", "by nd", "by nc", "by"):
        name = "cc-" + parts.replace(" ", "-")
        spoken = " ".join(words[p] for p in parts.split())
        for v in ("4.0", "3.0", "2.5", "2.0", "1.0"):
            n = v.replace(".", " ")
            found += [
                Rule(f"{name}-{v}", "creativecommons", rf"creativecommons org licenses {parts} {n}"),
                Rule(f"{name}-{v}", "commons", rf"creative commons {spoken} {n}(?: (?:international|unported|generic))?"),
                Rule(f"{name}-{v}", "cc", rf"cc {parts} {n}"),
            ]
        found += [Rule(name, "commons", rf"creative commons {spoken}"), Rule(name, "cc", rf"cc {parts}")]
    return found


def build_rules() -> list[Rule]:
    """All rules, the most telling first."""
    found = [
        *_versioned("agpl", "3.0 1.0", "affero", "(?:gnu )?affero general public license", "agpl"),
        *_versioned("lgpl", "3.0 2.1 2.0", "lesser", "(?:gnu )?lesser general public license", "lgpl"),
        *_versioned("lgpl", "2.0", "library", "(?:gnu )?library general public license", "lgpl"),
        *_versioned("gpl", "3.0 2.0 1.0", "gnu", "gnu general public license", "gpl"),
        *_versioned("apache", "2.0 1.1 1.0", "apache", "apache (?:software )?license", "apache"),
        *_versioned("mpl", "2.0 1.1 1.0", "mozilla", "mozilla public license", "mpl"),
        *_versioned("epl", "2.0 1.0", "eclipse", "eclipse public license", "epl"),
        *_versioned("cddl", "1.1 1.0", "distribution", "common development and distribution license", "cddl"),
        *_versioned("eupl", "1.2 1.1 1.0", "union", "european union public licen[cs]e", "eupl"),
        *_versioned("artistic", "2.0 1.0", "artistic", "artistic license", "artistic"),
        *_versioned("osl", "3.0 2.1 2.0", "open", "open software license", "osl"),
        *_versioned("afl", "3.0 2.1 2.0", "academic", "academic free license", "afl"),
        *_versioned("ofl", "1.1 1.0", "font", "(?:sil )?open font license", "ofl"),
        *_versioned("odbl", "1.0", "database", "open (?:data commons )?database license", "odbl"),
        *_versioned("bsl", "1.0", "boost", "boost software license", "bsl"),
        *_versioned("zpl", "2.1 2.0", "zope", "zope public license", "zpl"),
        *_versioned("lppl", "1.3 1.2", "latex", "latex project public license", "lppl"),
        *_versioned("cecill", "2.1 2.0", "cecill", "cecill free software license", "cecill"),
        *_versioned("upl", "1.0", "universal", "universal permissive license", "upl"),
        *_versioned("gfdl", "1.3 1.2 1.1", "documentation", "gnu free documentation license", "gfdl"),
        *_versioned("cpl", "1.0", "common", "common public license", "cpl"),
        *_versioned("sspl", "1.0", "server", "server side public license", "sspl"),
        *_commons(),
    ]
    single = [
        ("cc0-1.0", "creativecommons", "creativecommons org publicdomain zero 1 0"), ("cc0-1.0", "cc0", "cc0 1 0(?: universal)?"), ("cc0", "cc0", "cc0"), ("pddl-1.0", "public", "open data commons public domain dedication"),
        ("mit", "opensource", "opensource org licenses mit"), ("mit", "spdx", "spdx license identifier mit"), ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy"), ("mit", "mit", "(?:expat )?mit licen[cs]e|licensed under (?:the )?(?:terms of the )?mit"), ("mit", "expat", "expat license"),
        ("isc", "isc", "isc license"), ("isc", "spdx", "spdx license identifier isc"), ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose"),
        ("bsd-2-clause", "bsd", "bsd 2 clause(?: license)?|simplified bsd license|(?:2|two) clause bsd(?: license)?"), ("bsd-3-clause", "bsd", "bsd 3 clause(?: license)?|(?:new|modified|revised) bsd license|(?:3|three) clause bsd(?: license)?"), ("bsd-4-clause", "bsd", "bsd 4 clause(?: license)?|original bsd license|(?:4|four) clause bsd(?: license)?"), ("0bsd", "bsd", "(?:0|zero) clause bsd(?: license)?"), ("bsd", "bsd", "bsd(?: style)? licen[cs]e"), ("bsd", "redistribution", "redistribution and use in source and binary forms"), ("bsd-3-clause", "endorse", "to endorse or promote products derived from this software"),
        ("unlicense", "unlicense", "(?:the )?unlicense"), ("unlicense", "unencumbered", "free and unencumbered software released into the public domain"), ("wtfpl", "wtfpl", "wtfpl"), ("zlib", "zlib", "zlib(?: libpng)? license"), ("zlib", "altered", "altered source versions must be plainly marked as such"), ("python", "python", "python software foundation license"), ("python", "psf", "psf license"), ("ruby", "ruby", "ruby license"), ("php", "php", "php license"), ("openssl", "openssl", "openssl license"), ("postgresql", "postgresql", "postgresql licen[cs]e"), ("vim", "vim", "vim license"), ("ncsa", "ncsa", "ncsa open source license"), ("json", "good", "shall be used for good not evil"), ("beerware", "beer", "beer ware license"), ("beerware", "beerware", "beerware license"), ("ms-pl", "microsoft", "microsoft public license"), ("ms-rl", "microsoft", "microsoft reciprocal license"),
        ("apache", "apache", "apache (?:software )?license"), ("apache-2.0", "apache", "www apache org licenses license 2 0"), ("agpl", "affero", "affero general public license"), ("lgpl", "lesser", "lesser general public license"), ("lgpl", "library", "library general public license"), ("gpl", "gnu", "gnu general public license"), ("gpl", "gpl", "gpl"), ("lgpl", "lgpl", "lgpl"), ("agpl", "agpl", "agpl"), ("mpl", "mozilla", "mozilla public license"), ("epl", "eclipse", "eclipse public license"), ("gfdl", "documentation", "free documentation license"), ("artistic", "artistic", "artistic license"), ("ofl", "font", "open font license"), ("odbl", "database", "open database license"),
        ("public-domain", "domain", "(?:released|placed|dedicated|is) (?:in|into|to) the public domain|public domain dedication"), ("all-rights-reserved", "rights", "all rights reserved"), ("copyright", "copyright", r"copyright (?:c )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])*"), ("proprietary", "proprietary", "proprietary(?: and confidential| license| software)"), ("no-warranty", "warranty", "without warranty of any kind|as is without warranty"), ("no-warranty", "warranties", "as is without warranties"), ("license-reference", "licensed", "licensed under the [^ ]+(?: [^ ]+)? licen[cs]e"), ("license-reference", "license", "see (?:the )?license(?: file)?(?: for (?:more )?details)?"), ("license-reference", "license", "under the terms of the [^ ]+(?: [^ ]+)? license"),
    ]
    return found + [Rule(*x) for x in single]


RULES = build_rules()
KEYWORDS = sorted({r.keyword for r in RULES})


def any_of(words: list[str]) -> str:
    """A regular expression for any of the words, with their common beginnings written once."""
    rest: dict[str, list[str]] = {}
    for w in words:
        if w:
            rest.setdefault(w[0], []).append(w[1:])
    parts = [c + any_of(ends) for c, ends in sorted(rest.items())]
    if not parts:
        return ""
    if "" in words:
        return "(?:" + "|".join(parts) + ")?"
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


def spoken(text: Column) -> Column:
    """A-Z in lower case and words between single spaces, with one before and after all; one space if there are no words."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.concat(F.lit(" "), lower, F.lit(" ")), SEPARATORS, " ")


def spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def base_columns(norm: Column) -> dict[str, Column]:
    """Places of the base phrases: all of them, the first and the last."""
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in sorted(BASE.items(), key=lambda x: x[1]):
        at = F.instr(norm, f" {phrase} ")
        there = at > 0
        after = F.substring_index(norm, f" {phrase} ", -1)
        counts.append(F.when(there, F.size(F.split(norm, f"(?<= ){phrase}(?= )", -1)) - 1).otherwise(0).cast("long"))
        firsts.append(F.when(there, spaces(F.left(norm, at)) - 1))
        lasts.append(F.when(there, spaces(F.left(norm, F.length(norm) - F.length(after) - len(phrase) - 1)) - 1))
        labels.append(F.when(there, F.lit(label)))
    return {"n_base": sum(counts[1:], counts[0]), "first_word": F.least(*firsts), "last_word": F.greatest(*lasts), "base": F.array_compact(F.array(*labels))}


def detections(norm: str = "norm") -> Column:
    """All matches of the rules whose keyword the text holds: rule number, label, which match of the rule it is, and the words in it and in the piece of text before it."""
    rules = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(r.label).alias("label"), F.lit(r.keyword).alias("keyword"), F.lit(f"(?<= )(?:{r.pattern})(?= )").alias("pattern")) for i, r in enumerate(RULES)])
    tried = F.filter(rules, lambda r: F.contains(F.col(norm), F.concat(F.lit(" "), r["keyword"], F.lit(" "))))
    found = F.transform(tried, lambda r: F.struct(r["rule"].alias("rule"), r["label"].alias("label"), F.regexp_extract_all(F.col(norm), r["pattern"], F.lit(0)).alias("hits"), F.split(F.col(norm), r["pattern"], -1).alias("pieces")))
    found = F.filter(found, lambda d: F.size(d["hits"]) > 0)

    def counted(d: Column) -> Column:
        return F.transform(d["hits"], lambda hit, i: F.struct(d["rule"].alias("rule"), d["label"].alias("label"), i.alias("nth"), spaces(d["pieces"][i]).alias("before"), spaces(hit).alias("inside")))

    return F.flatten(F.transform(found, counted))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base places and labels, all labels and the share of words that kept detections cover, from 0 to 1.

    One pass over the texts leaves narrow rows; what follows reads these alone.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), spoken(F.col("text")).alias("norm"))
    gate = f" {any_of(KEYWORDS)} "
    found = F.when(F.col("norm").rlike(gate), detections()).alias("found")
    seen = rows.select("doc_id", F.xxhash64("norm").alias("copy"), (spaces(F.col("norm")) - 1).alias("n_words"), *[c.alias(n) for n, c in base_columns(F.col("norm")).items()], found)
    seen = common.saved(seen, "license-scan")
    hits = seen.filter("size(found) > 0").select("doc_id", "copy", "found").repartition("doc_id", "copy").select("doc_id", "copy", F.inline("found"))
    # a match begins after the words of all pieces up to it and of all matches before it
    same = Window.partitionBy("doc_id", "copy", "rule").orderBy("nth")
    hits = hits.dropDuplicates(["doc_id", "copy", "rule", "nth"]).withColumn("first", F.sum(F.col("before") + F.col("inside")).over(same) - F.col("inside") - 1)
    hits = hits.withColumn("end", F.col("first") + F.col("inside") + 1)
    order = Window.partitionBy("doc_id", "copy").orderBy("first", F.desc("end"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    kept = hits.withColumn("reach", F.max("end").over(order)).filter("reach IS NULL OR reach < end")
    own = kept.groupBy("doc_id", "copy").agg(F.array_sort(F.collect_set("label")).alias("own"), F.count("*").alias("n_detections"), F.sum(F.col("end") - F.greatest("first", F.coalesce("reach", F.lit(0)))).alias("covered"))
    own = own.select(F.col("doc_id").alias("own_id"), F.col("copy").alias("own_copy"), "own", "n_detections", "covered")
    out = seen.join(own, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("copy") == F.col("own_copy")), "left")
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(F.col("base"), F.coalesce("own", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.col("covered") > 0, F.least(F.lit(1.0), F.col("covered").cast("double") / F.col("n_words"))).otherwise(0.0).alias("score"),
        F.coalesce("n_detections", F.lit(0)).cast("long").alias("n_detections"),
    )


def _sql() -> str:
    """The same in DuckDB. Its patterns have no lookaround, so every space is doubled and a match takes one of each pair."""

    def doubled(pattern: str) -> str:
        return pattern.replace(" ", "  ").replace("  ?", "(?:  )?").replace("'", "''")

    rules = ", ".join(f"({i}, '{r.label}', '{r.keyword}', ' (?:{doubled(r.pattern)}) ')" for i, r in enumerate(RULES))
    base = ", ".join(f"({-1 - i}, '{label}', '{phrase}', ' (?:{doubled(phrase)}) ')" for i, (phrase, label) in enumerate(BASE.items()))
    return f"""
WITH rules(rule, label, keyword, pattern) AS (VALUES {rules}, {base}),
n AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(' ' || translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || ' ', '{SEPARATORS}', ' ', 'g') AS norm FROM documents),
t AS (SELECT r, rule, label, regexp_extract_all(replace(norm, ' ', '  '), pattern) AS hits, regexp_split_to_array(replace(norm, ' ', '  '), pattern) AS pieces FROM n JOIN rules ON contains(norm, ' ' || keyword || ' ')),
u AS (SELECT r, rule, label, unnest(hits) AS hit, unnest(pieces[:len(hits)]) AS piece, unnest(range(len(hits))) AS nth FROM t WHERE len(hits) > 0),
w AS (SELECT r, rule, label, nth, len(list_filter(string_split(hit, ' '), lambda x: x <> '')) AS inside, len(list_filter(string_split(piece, ' '), lambda x: x <> '')) AS before FROM u),
p AS (SELECT r, rule, label, sum(before + inside) OVER (PARTITION BY r, rule ORDER BY nth) - inside AS first, inside FROM w),
b AS (SELECT r, count(*) AS n_base, min(first) AS first_word, max(first) AS last_word, list_sort(list_distinct(list(label))) AS base FROM p WHERE rule < 0 GROUP BY r),
k AS (SELECT r, label, first, first + inside AS "end", max(first + inside) OVER (PARTITION BY r ORDER BY first, inside DESC, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p WHERE rule >= 0),
o AS (SELECT r, list(label) AS own, count(*) AS n_detections, sum("end" - greatest(first, coalesce(reach, 0))) AS covered FROM k WHERE reach IS NULL OR reach < "end" GROUP BY r)
SELECT doc_id, len(norm) - len(replace(norm, ' ', '')) - 1 AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  array_to_string(coalesce(base, []), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(own, [])))), ',') AS labels,
  CASE WHEN covered > 0 THEN least(1.0::DOUBLE, covered::DOUBLE / (len(norm) - len(replace(norm, ' ', '')) - 1)) ELSE 0.0::DOUBLE END AS score, CAST(coalesce(n_detections, 0) AS BIGINT) AS n_detections
FROM n LEFT JOIN b ON b.r = n.r LEFT JOIN o ON o.r = n.r
"""


OP5_SQL = _sql()


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))
