"""Collocations against counting all phrases."""

import collections
import random
import re

import numpy as np
import pytest

from spikeframe.llm import collocations


def brute(rows, least, best=2000):
    counts, total = collections.defaultdict(collections.Counter), collections.Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, 5):
                for k in range(len(words) - m + 1):
                    counts[lang][tuple(words[k:k + m])] += 1
    out = []
    for lang, f in counts.items():
        found = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        gone = {g[i:i + m] for g, a in found.items() for m in range(2, len(g)) for i in range(len(g) - m + 1)
                if 100 * a >= 80 * f[g[i:i + m]]}
        rows_ = []
        for g, a in found.items():
            if g not in gone:
                score, k, left, right = min((2000000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
                rows_.append((-score, -a, " ".join(g).encode(), left, right))
        for n, (score, a, phrase, left, right) in enumerate(sorted(rows_)[:best]):
            out.append((lang, n + 1, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def got(df, **options):
    return sorted(map(tuple, collocations.collocations(df, **options).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def sample(n, seed):
    rnd = random.Random(seed)
    words = ["The", "house", "of", "é", "cards", "new", "YORK", "city", "x1", "漢字", "a😀b", " nb", "ſ", "i̇"]
    rows = []
    for _ in range(n):
        text = []
        for _ in range(rnd.randint(0, 30)):
            text.append(rnd.choice(["new york city", "New  York\tCity hall", "house of cards"]) if rnd.random() < .3 else rnd.choice(words))
            if rnd.random() < .2:
                text.append(rnd.choice([".", ", ", ";", "!x", "\n", "\r\n", "\x0b", " : "]))
        rows.append((" ".join(text), rnd.choice(["en", "en", "de", None, "und"])))
    return rows


def test_all_phrases(spark):
    rows = sample(600, 1)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    want = brute(rows, 10)
    assert {len(r[2].split(" ")) for r in want} == {2, 3, 4} and got(df, least=10) == want
    # several tries, small chunks, few of each language
    assert got(df, least=10, trie_phrases=40, chunk_bytes=500) == want
    assert got(df, least=10, best=7) == brute(rows, 10, 7)


def test_odd_rows(spark, documents, odd):
    for df, least in ((odd, 2), (documents, 30)):
        want = brute([(r.text, r.lang) for r in df.collect()], least)
        assert want and got(df, least=least) == want
    assert got(odd.limit(0)) == [] and got(odd, least=10 ** 9) == []


@pytest.mark.parametrize("n, words, depth", [(1, 1, 2), (30, 5, 2), (3000, 90, 3), (20000, 4000, 4)])
def test_double_array(n, words, depth):
    rng = np.random.default_rng(n)
    numbers = np.unique(rng.integers(0, 1 << 40, words))
    phrases = np.unique(numbers[(rng.random((n, depth)) ** 2 * len(numbers)).astype(int)], axis=0)
    trie = collocations.DoubleArray(phrases)
    own = np.append(numbers, -1)
    places = (rng.random(5000) ** 2 * (len(numbers) + 1)).astype(np.int32)
    places[places == len(numbers)] = -1
    position, state = trie.advance(numbers, places)
    rows = {tuple(p): k for k, p in enumerate(phrases.tolist())}
    want = [(k, rows[g]) for k in range(len(places) - depth + 1) if (g := tuple(own[places[k:k + depth]].tolist())) in rows]
    assert list(zip(position.tolist(), trie.row[state].tolist())) == want
