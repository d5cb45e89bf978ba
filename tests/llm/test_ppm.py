"""Scores of whole texts against a trie counted by brute force."""

import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from engram.llm import ppm
from tests.llm.test_operators import AWKWARD, frame, random_texts


def _trie(texts, order, least):
    trie = defaultdict(lambda: defaultdict(int))
    for t in texts:
        s = ppm.stream(t or "")
        for i in range(1, len(s)):
            for k in range(min(i, order) + 1):
                trie[s[i - k : i]][s[i]] += 1
    return {c: dict(x) for c, x in trie.items() if sum(x.values()) >= least}


class Coder:
    """log10 probabilities of single texts, from {context: {symbol: count}}, as the library computes them for tables."""

    def __init__(self, trie: dict[bytes, dict[int, int]], order: int):
        self.trie, self.order, self.below = trie, order, {}

    def text(self, text: str) -> float:
        s = ppm.stream(text)
        return sum(self.symbol(s[max(0, i - self.order) : i], s[i]) for i in range(1, len(s)))

    def symbol(self, context: bytes, symbol: int) -> float:
        while context and context not in self.trie:
            context = context[1:]
        # (symbols left and their counts, n + d, log10 of escapes so far), from the longest context down
        levels = self.below.get(context)
        if levels is None:
            levels, out, escaped, at = [], set(), 0.0, context
            while True:
                left = {s: n for s, n in self.trie.get(at, {}).items() if s not in out}
                n, d = sum(left.values()), len(left)
                levels.append((left, n + d, escaped))
                if left:
                    escaped += math.log10(d / (n + d))
                out.update(left)
                if not at:
                    break
                at = at[1:]
            levels.append((None, max(1, ppm.SYMBOLS - len(out)), escaped))
            self.below[context] = levels
        for left, total, escaped in levels:
            if left is None:
                return escaped - math.log10(total)
            if symbol in left:
                return escaped + math.log10(left[symbol] / total)
        raise AssertionError


def test_score_equals_brute_force_and_sees_word_order(spark):
    rnd = random.Random(11)
    texts = [t and t[:3000] for t in AWKWARD] + random_texts(12, 80)
    words = texts[-2].split()
    texts += [" ".join(words), " ".join(rnd.sample(words, len(words)))]
    train = lambda i: i % 7 != 2 and i < len(texts) - 2
    for least, common in ((1.0, 1e-3), (4.0, 1.0)):
        coder = Coder(_trie([t for i, t in enumerate(texts) if train(i)], 5, least), 5)
        on = (F.col("doc_id") % 7 != 2) & (F.col("doc_id") < len(texts) - 2)
        got = {r.doc_id: r.score for r in ppm.score(frame(spark, texts), on, least=least, common=common).collect()}
        for i, t in enumerate(texts):
            assert math.isclose(got[i], coder.text(t or ""), rel_tol=1e-9), i
        assert got[len(texts) - 2] > got[len(texts) - 1]


def test_the_symbols_of_a_context_sum_to_one():
    rnd = random.Random(2)
    coder = Coder(_trie(random_texts(3, 30) + ["", "aaaa", "é\U00010348"], 5, 1), 5)
    contexts = [c for c in coder.trie if c] + [b"", b"zzz", b"\xff"]
    for c in rnd.sample(contexts, 200):
        assert math.isclose(sum(10 ** coder.symbol(c, s) for s in range(ppm.SYMBOLS)), 1, rel_tol=1e-9), c
