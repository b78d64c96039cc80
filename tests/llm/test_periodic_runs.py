"""Runs of periodic words against comparing all shifts of a text."""

import hashlib
import random
import re
import zlib

import pytest

from haulcast.llm import periodic_runs as p

DOCS = "doc_id long, text string"


def plain(words, least):
    """All runs by comparing the text with itself at every shift."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] == words[i + q]:
                j = i
                while j + q < n and words[j] == words[j + q]:
                    j += 1
                length = j - i + q
                smaller = any(all(words[k] == words[k + d] for k in range(i, i + length - d)) for d in range(1, q))
                if length >= max(least, 2 * q) and not smaller:
                    out.append((i, length, q))
                i = j
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def looped(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    q = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % q] if i >= a else words[i] for i in range(n)]


def expected(data, least=12):
    out = []
    for doc, text in data:
        words = looped(doc, text)
        runs = plain(words, least)
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in runs)]
        best = min(((-length, s, q) for s, length, q in runs), default=None)
        start, length, q = (best[1], -best[0], best[2]) if best else (None, None, None)
        lines = "".join(f"{s},{length_},{q_}\n" for s, length_, q_ in runs)
        out.append((doc, len(runs), start, length, q, length * 1000 // q if best else None,
                    hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in p.run_digests(p.find_runs(p.with_planted_loops(df))).collect()), key=repr)


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_of_words_equal_plain_search(least):
    rnd = random.Random(least)
    for _ in range(300):
        words = [str(rnd.randint(1, rnd.randint(1, 4))) for _ in range(rnd.randint(0, 60))]
        if words and rnd.random() < 0.5:
            a, q = rnd.randrange(len(words)), rnd.randint(1, 8)
            words = [words[a + (i - a) % q] if i >= a and a + (i - a) % q < len(words) else words[i] for i in range(len(words))]
        assert p.text_runs(" ".join(words).encode(), least)[1] == plain(words, least)


def test_documents_equal_plain_search(spark, rows):
    rnd = random.Random(8)
    words = ["a", "b", "ab", "é", "x y", " ", "-", "q1"]
    data = [(k, "".join(w + rnd.choice([" ", "\t", "\n ", "  ", "\x0b"]) for w in rnd.choices(words, k=rnd.randint(0, 50))))
            for k in range(200)]
    assert result(rows(data, DOCS).repartition(4)) == expected(data)


def test_edge_rows(spark, rows):
    data = [(1, None), (None, ""), (None, "a " * 20), (2, " \t\n"), (3, "a b " * 30), (3, "a b " * 30), (26, None), (30, "x")]
    assert result(rows(data, DOCS)) == expected(data)
    assert result(rows([], DOCS)) == []
    extra = rows([(3, "a b " * 30, 1, "s", 2)], DOCS + ", g int, runs string, collapsed int")
    assert result(extra) == expected([(3, "a b " * 30)])


def test_very_long_periodic_text():
    """100,000 words of one period are one run and collapse to one period; so do those with a break."""
    period = [f"w{k}" for k in range(7)]
    n, runs, kept = p.text_runs(" ".join(period * 14_000).encode())
    assert (n, runs, kept.decode()) == (98_000, [(0, 98_000, 7)], " ".join(period))
    same = p.text_runs(b"a " * 50_000)
    assert same == (50_000, [(0, 50_000, 1)], b"a")


def test_paths_and_automaton():
    """Occurrences that the automaton tells by its colours are those of the text."""
    words = [1, 2, 1, 2, 1, 3, 1, 2, 1]
    link, longest, prefixes = p.suffix_automaton(words)
    paths = p.LinkCutPaths(link)
    for place, state in enumerate(prefixes):
        for node, before in paths.access(state, place):
            length = longest[node]
            ends = [e for e in range(place) if e + 1 >= length and words[e + 1 - length: e + 1] == words[place + 1 - length: place + 1]]
            assert before == max(ends, default=-1)
