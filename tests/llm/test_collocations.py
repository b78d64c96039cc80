"""Collocations against counting by hand, and their automata against plain dictionaries."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from haulcast.llm import collocations as c
from haulcast.llm.transducers import CountTransducer, of_sorted_words, union

DOCS = "doc_id long, text string, lang string"


def by_hand(rows, least, longest, cover, top):
    f, n = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f.setdefault(lang, Counter())[tuple(words[i: i + k])] += 1
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in often.items():
            if any(len(q) > len(p) and 100 * b >= cover * a and any(q[i: i + len(p)] == p for i in range(len(q)))
                   for q, b in often.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]])
                                        for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.collect())


def texts(count, seed=5):
    rnd = random.Random(seed)
    words = ["red", "Fish", "éa", "sea", "the", "x1", "ça va", " ", "a.b", "stop.", "go,", "of", "tab\tcut", "line\nend"]
    return [(k, " ".join(rnd.choices(words, weights=[9, 9, 5, 5, 20, 3, 2, 1, 2, 4, 3, 8, 1, 1], k=rnd.randint(0, 40))),
             rnd.choice(["en", "en", "en", None, "de", "und"])) for k in range(count)]


@pytest.mark.parametrize("least, longest, cover, top", [(10, 3, 50, 2000), (2, 3, 100, 7), (3, 2, 50, 50), (2, 4, 60, 200)])
def test_equals_counting_by_hand(spark, rows, least, longest, cover, top):
    data = texts(150)
    found = c.collocations(rows(data, DOCS).repartition(5), least, longest, cover, top, ranges=7)
    assert result(found) == by_hand(data, least, longest, cover, top)


def test_edge_rows(spark, rows):
    data = [(1, None, "en"), (None, "", "en"), (3, "one", None), (3, " ,; \n", "fr"), *[(4, "a b\x85 c", "fr")] * 12,
            (5, "long " * 60_000, "en")]
    assert result(c.collocations(rows(data, DOCS))) == by_hand(data, 10, 3, 50, 2000)
    assert result(c.collocations(rows([], DOCS))) == []
    extra = rows([(1, "a b " * 10, "en", 7, "z")], DOCS + ", range int, words string").drop("doc_id")
    assert result(c.collocations(extra)) == by_hand([(1, "a b " * 10, "en")], 10, 3, 50, 2000)


def test_small_shards_and_slices_change_nothing(spark, rows, monkeypatch):
    data = texts(60, seed=9)
    shard = c.Shard(3, 4)
    monkeypatch.setattr(c, "SLICE_BYTES", 7)
    for _, text, lang in data:
        shard.add(lang or "und", text.encode())
    united = {}
    for lang, k, part in shard.counted():
        assert (lang, k) not in united
        united[lang, k] = part
    counts = Counter()
    for part in united.values():
        for phrase, n in c._phrases(part, 3):
            counts[phrase] += n
    whole = Counter()
    for _, text, _ in data:
        lowered = text.encode().lower().decode()
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = [w.encode() for w in re.findall(r"[^\x20\x09]+", piece)]
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    whole[tuple(words[i: i + k])] += 1
    assert counts == whole


def transducer(counts):
    number, labels = {}, []
    for phrase in counts:
        labels.append([number.setdefault(w, len(number) + 1) for w in phrase] + [0] * (3 - len(phrase)))
    return of_sorted_words(number, np.array(labels, dtype=np.int64).reshape(-1, 3), np.array(list(counts.values()), dtype=np.int64))


def phrases(found: CountTransducer):
    return dict(c._phrases(found, 3))


def test_transducers_equal_dictionaries():
    rnd = random.Random(3)
    for _ in range(60):
        parts = []
        for _ in range(rnd.randint(0, 4)):
            counts = Counter()
            for _ in range(rnd.randint(0, 30)):
                counts[tuple(bytes([97 + rnd.randrange(5)]) for _ in range(rnd.randint(1, 3)))] += rnd.randint(1, 3)
            parts.append((transducer(counts), counts))
            assert phrases(parts[-1][0]) == dict(counts)
        total = sum((counts for _, counts in parts), Counter())
        whole, singles = union([t for t, _ in parts], 3, 3)
        assert phrases(whole) == {p: n for p, n in total.items() if n >= 3}
        assert singles == sum(n for p, n in total.items() if len(p) == 1)
        for asked, _ in parts:
            labels, weights = whole.compose(asked, 3)
            for row, n in zip(labels.tolist(), weights.tolist()):
                assert n == phrases(whole).get(tuple(asked.words[k - 1] for k in row if k), 0)


def test_equal_states_are_shared():
    """The states after "a" and "b" have the same arcs, so they are one."""
    found = transducer({(b"a", b"x"): 2, (b"a", b"y"): 1, (b"b", b"x"): 2, (b"b", b"y"): 1})
    arcs = range(found.first[-2], found.first[-1])
    assert len({found.target[k] for k in arcs}) == 1 and len(arcs) == 2


def test_many_labels_do_not_fit_one_number():
    labels = np.array([[3_000_000, 1, 2], [3_000_000, 1, 1], [1, 2, 0], [3_000_000, 1, 2]], dtype=np.int64)
    distinct, weights = c.summed(labels, np.array([1, 2, 3, 4]), 3_000_000)
    assert distinct.tolist() == [[1, 2, 0], [3_000_000, 1, 1], [3_000_000, 1, 2]] and weights.tolist() == [3, 2, 5]
