"""Licence scan against a plain scan of the words."""

import random
import re

from haulcast.llm import license_scan as s

DOCS = "doc_id long, text string"


def plain(rows, templates=s.TEMPLATES, given=s.PHRASES):
    files = []
    for _, text in rows:
        lowered = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in text or "")
        files.append(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered))
    words = {w for t in templates for w in t.words} | {w for p in given for w in p.split()}
    files_with = {w: sum(w in f for f in files) for w in words}
    out = []
    for (doc, _), f in zip(rows, files):
        base = [(i, label) for p, label in given.items() for i in range(len(f)) if f[i: i + len(p.split())] == p.split()]
        notices = []
        for t in templates:
            rare = set(sorted(set(t.words), key=lambda w: (files_with[w] == 0, files_with[w], w))[: s.RARE_WORDS])
            places = [p for p, w in enumerate(t.words) if w in rare]
            for start in range(-len(t.words), len(f)):
                at = lambda p: f[start + p] if 0 <= start + p < len(f) else None
                if 4 * sum(at(p) == t.words[p] for p in places) < 3 * len(places):
                    continue
                keys = [k.split() for k in t.key_phrases]
                where = [next(i for i in range(len(t.words)) if t.words[i: i + len(k)] == k) for k in keys]
                if all([at(i + d) for d in range(len(k))] == k for i, k in zip(where, keys)):
                    notices.append((t.label, sum(at(p) == w for p, w in enumerate(t.words)) / len(t.words)))
        labels = {label for _, label in base}
        out.append((doc, len(f), len(base), min((i for i, _ in base), default=None), max((i for i, _ in base), default=None),
                    ",".join(sorted(labels)), ",".join(sorted(labels | {n for n, _ in notices})),
                    1.0 if base else max((share for _, share in notices), default=0.0)))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in s.licence_labels(s.scan_licences(df)).collect()), key=repr)


def test_equals_plain_scan(spark, rows):
    rnd = random.Random(4)
    filler = ["license", "the", "under", "mit", "gnu", "free", "version", "2", "0", "Ünder", "x", "software", "cc", "by"]
    data = []
    for k in range(250):
        words = rnd.choices(filler, k=rnd.randint(0, 25))
        for _ in range(rnd.randint(0, 2)):
            words[rnd.randint(0, len(words)):0] = rnd.choice([*[t.notice for t in s.TEMPLATES], *s.PHRASES]).split()
        for _ in range(rnd.randint(0, 3)):
            if words:
                words[rnd.randrange(len(words))] = rnd.choice(filler)
        joined = "".join(w.upper() + rnd.choice([" ", ", ", "\n", "-", " (c) "]) if rnd.random() < 0.3 else w + " " for w in words)
        data.append((k, joined))
    assert result(rows(data, DOCS)) == plain(data)


def test_edge_rows(spark, rows):
    data = [(1, None), (None, ""), (2, " .,-\n"), (3, "under the mit license"), (3, "Under The MIT License"),
            (4, "under the mit license " * 3000), (5, "mit license"), (6, "apache license version 20"), (7, "CC BY-NC"),
            (8, "gnu general public license version"), (9, "cc by nc")]
    assert result(rows(data, DOCS)) == plain(data)
    assert result(rows([], DOCS)) == []
    extra = rows([(1, "Released under the MIT License.", 5, "q")], DOCS + ", w int, hits string")
    assert result(extra) == [(1, 5, 1, 1, 1, "mit", "mit", 1.0)]


def test_notices_of_other_licences_and_their_places(spark, rows):
    text = "Intro. Redistribution and use in source and binary forms, with or without modification, are permitted provided that:"
    found = s.scan_licences(rows([(1, text)], DOCS)).first()
    assert [(n.label, n.start) for n in found.notices] == [("bsd", 1)] and 0.7 < found.notices[0].share < 1
    broken = text.replace("binary forms", "binary files")
    assert s.scan_licences(rows([(1, broken)], DOCS)).first().notices == []
