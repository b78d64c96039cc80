"""Licences named in texts, by a positional index of rare licence words; DataFrame operations only.

Templates are the words of licence notices. One pass counts in how many documents each
template word occurs. The index holds, for each template, the places of its few words
with the highest inverse document frequency. A second pass looks up each file's words in
the index: every posting proposes a start, the word's place in the file less its place in
the template. A start stays if most of the template's rare words stand at their relative
places there, and if all its mandatory key phrases stand word by word at theirs.

Given phrases are found exactly, at every place, from the place of their rarest word.

Everything about a file is computed in its own row, without a shuffle; only one number per
template word reaches the driver. Work per file is linear in its words and in its hits.

Edge cases: null counts as empty; an empty text has no words and no places. Ids may be
null or repeated; each row is scanned alone. An empty table gives an empty result. Columns
besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulcast.llm.text import LOWER, UPPER, ascii_lower, split_words

# Fixed value: what stands between words. Words are runs of a-z, 0-9 and characters outside ASCII, after lower-casing A-Z.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# rare words of a template that are indexed, and the share of their places that must agree
RARE_WORDS, AGREEING = 4, 0.75
# a proposed start is kept in one number with its template
_SHIFT = 32


@dataclass(frozen=True)
class Template:
    """Words of a licence notice, and the phrases in it without which it is not that licence."""

    label: str
    notice: str
    key_phrases: tuple[str, ...]

    @property
    def words(self) -> list[str]:
        return self.notice.split()


# The phrases that are found at every place, with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Opening words of common licence notices.
TEMPLATES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
             "associated documentation files the software to deal in the software without restriction",
             ("permission is hereby granted free of charge",)),
    Template("mit", "released under the mit license", ("the mit license",)),
    Template("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
             "provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee "
             "is hereby granted", ("for any purpose with or without fee",)),
    Template("gpl", "licensed under the gnu general public license version", ("gnu general public license",)),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
             "general public license as published by the free software foundation",
             ("gnu general public license", "free software foundation")),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software "
             "foundation", ("gnu lesser general public license",)),
    Template("agpl", "under the terms of the gnu affero general public license as published by the free software "
             "foundation", ("gnu affero general public license",)),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0",
             ("mozilla public license v 2",)),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license",
             ("creative commons attribution 4",)),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license",
             ("creative commons attribution sharealike",)),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international "
             "license", ("creative commons attribution noncommercial 4",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("under cc by nc",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             ("free and unencumbered software",)),
)


def _texts(values: Sequence[str]) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def file_words(docs: DataFrame) -> DataFrame:
    """doc_id and w, the file's licence words in order."""
    return docs.select("doc_id", ascii_lower("text").alias("t")).select("doc_id", split_words("t", BETWEEN_WORDS).alias("w"))


def document_frequencies(files: DataFrame, words: Sequence[str]) -> dict[str, int]:
    """Number of files with each of the given words; one pre-aggregated number per word reaches the driver."""
    present = files.select(F.explode(F.expr(f"array_intersect(w, {_texts(sorted(set(words)))})")).alias("word"))
    found = {r["word"]: r["n"] for r in present.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return {w: found.get(w, 0) for w in words}


def rare_words(words: Sequence[str], files_with: Mapping[str, int], count: int = RARE_WORDS) -> list[str]:
    """The words with the highest inverse document frequency, ties in their order; words of no file come last."""
    return sorted(set(words), key=lambda w: (files_with[w] == 0, files_with[w], w))[:count]


@dataclass(frozen=True)
class LicenceIndex:
    """Postings of the rare words of all templates, and the rarest word of each given phrase."""

    templates: Sequence[Template]
    rare_places: list[list[int]]
    phrases: Mapping[str, str]
    pivots: dict[str, int]

    @classmethod
    def of(cls, templates: Sequence[Template], phrases: Mapping[str, str], files_with: Mapping[str, int]) -> "LicenceIndex":
        places = []
        for t in templates:
            rare = rare_words(t.words, files_with)
            places.append([p for p, w in enumerate(t.words) if w in rare])
        pivots = {p: p.split().index(rare_words(p.split(), files_with, 1)[0]) for p in phrases}
        return cls(templates, places, phrases, pivots)

    def postings(self) -> dict[str, list[tuple[int, int]]]:
        """Word to (template, place)."""
        out: dict[str, list[tuple[int, int]]] = {}
        for t, places in enumerate(self.rare_places):
            for p in places:
                out.setdefault(self.templates[t].words[p], []).append((t, p))
        return out


def _template_structs(index: LicenceIndex) -> str:
    """Array of (label, words, rare places, needed, key phrases with their places) as a SQL literal."""
    rows = []
    for t, places in zip(index.templates, index.rare_places):
        keys = []
        for phrase in t.key_phrases:
            words = phrase.split()
            at = next(k for k in range(len(t.words)) if t.words[k: k + len(words)] == words)
            keys.append(f"named_struct('at', {at}, 'words', {_texts(words)})")
        needed = -(-len(places) * int(100 * AGREEING) // 100)
        rows.append(f"named_struct('label', '{t.label}', 'words', {_texts(t.words)}, 'rare', array({', '.join(map(str, places))}), "
                    f"'needed', {needed}, 'key_phrases', array({', '.join(keys)}))")
    return f"array({', '.join(rows)})"


def scan_licences(docs: DataFrame, templates: Sequence[Template] = TEMPLATES,
                  phrases: Mapping[str, str] = PHRASES) -> DataFrame:
    """One row per document: doc_id, n_words, phrases as (start, label), and notices as (label, start, share).

    ``share`` is the share of the template's words that stand at their places.
    """
    files = file_words(docs)
    vocabulary = [w for t in templates for w in t.words] + [w for p in phrases for w in p.split()]
    index = LicenceIndex.of(templates, phrases, document_frequencies(files, vocabulary))
    postings = index.postings()
    indexed = sorted({*postings, *[p.split()[k] for p, k in index.pivots.items()]})
    listed = ", ".join(f"'{w}'" for w in indexed)
    # places of indexed words, counted from 0
    hits = f"CASE WHEN size(w) > 0 THEN filter(sequence(0, size(w) - 1), i -> w[i] IN ({listed})) ELSE cast(array() AS array<int>) END"
    rows = files.select("doc_id", "w", F.expr(hits).alias("hits"))

    of_word = "map(" + ", ".join(
        f"'{word}', array({', '.join(str((t << _SHIFT) - p) + 'L' for t, p in found)})" for word, found in postings.items()) + ")"
    proposed = f"array_distinct(flatten(transform(hits, i -> transform(coalesce({of_word}[w[i]], cast(array() AS array<bigint>)), q -> q + i))))"
    # a start before the first word borrows from the template number: told apart by half a shift
    low = 1 << (_SHIFT - 1)
    split = (f"transform({proposed}, c -> named_struct('t', cast(shiftright(c + {low}L, {_SHIFT}) AS int), "
             f"'start', cast(c - shiftleft(shiftright(c + {low}L, {_SHIFT}), {_SHIFT}) AS int)))")
    shapes = _template_structs(index)
    joined = f"transform({split}, x -> named_struct('start', x.start, 't', {shapes}[x.t]))"
    stands = "(x.start + {0} >= 0 AND get(w, x.start + {0}) <=> {1})"
    verified = (f"filter({joined}, x -> size(filter(x.t.rare, p -> {stands.format('p', 'x.t.words[p]')})) >= x.t.needed "
                "AND forall(x.t.key_phrases, k -> x.start + k.at >= 0 AND slice(w, x.start + k.at + 1, size(k.words)) = k.words))")
    share = f"size(filter(sequence(0, size(x.t.words) - 1), p -> {stands.format('p', 'x.t.words[p]')})) / size(x.t.words)"
    notices = f"transform({verified}, x -> named_struct('label', x.t.label, 'start', cast(x.start AS bigint), 'share', {share}))"

    exact = []
    for phrase, label in phrases.items():
        words, k = phrase.split(), index.pivots[phrase]
        at = f"filter(hits, i -> w[i] = '{words[k]}' AND i >= {k} AND slice(w, i - {k} + 1, {len(words)}) = {_texts(words)})"
        exact.append(f"transform({at}, i -> named_struct('start', cast(i - {k} AS bigint), 'label', '{label}'))")
    return rows.select("doc_id", F.size("w").cast("long").alias("n_words"), F.expr(f"concat({', '.join(exact)})").alias("phrases"),
                       F.expr(notices).alias("notices"))


def licence_labels(found: DataFrame) -> DataFrame:
    """Places, labels and a score of the result of ``scan_licences``: 1 where a given phrase stands, else the best notice's share."""
    base = F.expr("array_sort(array_distinct(phrases.label))")
    both = F.expr("array_sort(array_union(phrases.label, notices.label))")
    score = F.expr("CASE WHEN size(phrases) > 0 THEN 1.0D ELSE coalesce(array_max(notices.share), 0.0D) END")
    return found.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min("phrases.start").alias("first_word"),
        F.array_max("phrases.start").alias("last_word"), F.array_join(base, ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"), score.alias("score"))


def licence_sql(templates: Sequence[Template] = TEMPLATES, phrases: Mapping[str, str] = PHRASES) -> str:
    """The same in DuckDB's SQL, with places, starts and frequencies as rows."""
    words = lambda text: "[" + ", ".join(f"'{w}'" for w in text.split()) + "]"
    places = lambda t, phrase: next(k for k in range(len(t.words)) if t.words[k:k + len(phrase.split())] == phrase.split())
    template_rows = ", ".join(f"({k}, '{t.label}', {words(t.notice)})" for k, t in enumerate(templates))
    key_rows = ", ".join(f"({k}, {places(t, p)}, {words(p)})" for k, t in enumerate(templates) for p in t.key_phrases)
    phrase_rows = ", ".join(f"('{label}', {words(p)})" for p, label in phrases.items())
    return rf"""
WITH files AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
templates(t, label, v) AS (VALUES {template_rows}),
keys(t, place, k) AS (VALUES {key_rows}),
phrases(label, v) AS (VALUES {phrase_rows}),
vocabulary AS (SELECT DISTINCT unnest(v) AS word FROM (SELECT v FROM templates UNION ALL SELECT v FROM phrases)),
tokens AS (SELECT rid, unnest(w) AS word, unnest(range(len(w))) AS i FROM files),
hits AS (SELECT rid, word, i FROM tokens SEMI JOIN vocabulary USING (word)),
frequencies AS (SELECT word, count(DISTINCT rid) AS n FROM vocabulary LEFT JOIN hits USING (word) GROUP BY word),
rare AS (
  SELECT t, word FROM (SELECT DISTINCT t, unnest(v) AS word FROM templates) JOIN frequencies USING (word)
  QUALIFY row_number() OVER (PARTITION BY t ORDER BY n = 0, n, word) <= {RARE_WORDS}),
postings AS (
  SELECT t, word, p, ceil({AGREEING} * count(*) OVER (PARTITION BY t)) AS needed
  FROM (SELECT t, unnest(v) AS word, unnest(range(len(v))) AS p FROM templates) SEMI JOIN rare USING (t, word)),
agreeing AS (
  SELECT rid, t, i - p AS start FROM hits JOIN postings USING (word) GROUP BY rid, t, i - p HAVING count(*) >= any_value(needed)),
notices AS (
  SELECT rid, label, len(list_filter(range(len(v)), lambda p: start + p >= 0 AND w[start + p + 1] = v[p + 1])) / len(v) AS share
  FROM agreeing a JOIN templates USING (t) JOIN files USING (rid)
  WHERE NOT EXISTS (SELECT 1 FROM keys WHERE keys.t = a.t
                    AND NOT (a.start + place >= 0 AND w[a.start + place + 1:a.start + place + len(k)] = k))),
base AS (
  SELECT rid, i AS start, label FROM hits JOIN phrases ON word = v[1] JOIN files USING (rid) WHERE w[i + 1:i + len(v)] = v),
base_of AS (
  SELECT rid, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY rid),
all_of AS (
  SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT rid, label FROM base UNION ALL SELECT rid, label FROM notices) GROUP BY rid),
best AS (SELECT rid, max(share) AS share FROM notices GROUP BY rid)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_base, 0)::bigint AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::double ELSE coalesce(share, 0.0::double) END AS score
FROM files LEFT JOIN base_of USING (rid) LEFT JOIN all_of USING (rid) LEFT JOIN best USING (rid)"""
