"""Text similarity: ROUGE-L, METEOR and greedy token matching. Arrow batches, row by row inside."""

from __future__ import annotations

import re
from collections.abc import Callable, Collection, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"[a-z0-9]+")
_VOWELS = "aeiou"


class Stemmer:
    """Porter's algorithm of 1980, as rules on the measure of a stem."""

    STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
    STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
    STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

    @staticmethod
    def _shape(word: str) -> str:
        """v and c for each letter; y is a vowel after a consonant."""
        out = ""
        for i, c in enumerate(word):
            out += "v" if c in _VOWELS or (c == "y" and i and out[-1] == "c") else "c"
        return out

    def _measure(self, stem: str) -> int:
        return len(re.findall("v+c+", self._shape(stem)))

    def _double(self, word: str) -> bool:
        return len(word) > 1 and word[-1] == word[-2] and self._shape(word)[-1] == "c"

    def _cvc(self, word: str) -> bool:
        return len(word) > 2 and self._shape(word)[-3:] == "cvc" and word[-1] not in "wxy"

    def _by_table(self, word: str, table: dict[str, str]) -> str:
        for end in sorted(table, key=len, reverse=True):
            if word.endswith(end):
                stem = word[: -len(end)]
                return stem + table[end] if self._measure(stem) > 0 else word
        return word

    def __call__(self, word: str) -> str:
        if len(word) <= 2:
            return word
        if word.endswith("sses") or word.endswith("ies"):
            word = word[:-2]
        elif word.endswith("s") and not word.endswith("ss"):
            word = word[:-1]
        if word.endswith("eed"):
            word = word[:-1] if self._measure(word[:-3]) > 0 else word
        else:
            for end in ("ed", "ing"):
                if word.endswith(end) and "v" in self._shape(word[: -len(end)]):
                    word = word[: -len(end)]
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif self._double(word) and word[-1] not in "lsz":
                        word = word[:-1]
                    elif self._measure(word) == 1 and self._cvc(word):
                        word += "e"
                    break
        if word.endswith("y") and "v" in self._shape(word[:-1]):
            word = word[:-1] + "i"
        word = self._by_table(self._by_table(word, self.STEP2), self.STEP3)
        for end in sorted(self.STEP4, key=len, reverse=True):
            if word.endswith(end):
                stem = word[: -len(end)]
                if self._measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                    word = stem
                break
        if word.endswith("e") and (self._measure(word[:-1]) > 1 or self._measure(word[:-1]) == 1 and not self._cvc(word[:-1])):
            word = word[:-1]
        return word[:-1] if self._measure(word) > 1 and self._double(word) and word[-1] == "l" else word


def tokenize(text: str | None, stem: bool) -> list[str]:
    found = _TOKEN.findall((text or "").lower())
    return [stemmer(t) if len(t) > 3 else t for t in found] if stem else found


stemmer = Stemmer()


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, with the rows of the table as bits of one integer."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = places.get(y, 0) & row
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def rouge_l_of(reference: str | None, answer: str | None, stem: bool = True) -> float:
    r, a = tokenize(reference, stem), tokenize(answer, stem)
    n = lcs(r, a) if r and a else 0
    return 2 * (n / len(a)) * (n / len(r)) / (n / len(a) + n / len(r)) if n else 0.0


def alignment(answer: list[str], reference: list[str], stages: Sequence[Callable[[str], Collection[str]]]) -> dict[int, int]:
    """Places of the answer's words to places of the reference's, stage by stage: two words match if a stage gives them a
    form in common.

    A stage goes from the answer's last word back to its first, and each word takes the last of the reference's words
    that is still free: of words that repeat, later ones meet later ones.
    """
    pairs: dict[int, int] = {}
    free = list(range(len(reference)))
    for forms in stages:
        waiting: dict[str, list[int]] = {}
        for j in free:
            for form in forms(reference[j]):
                waiting.setdefault(form, []).append(j)
        taken: set[int] = set()
        for i in range(len(answer) - 1, -1, -1):
            if i in pairs:
                continue
            last = -1
            for form in forms(answer[i]):
                places = waiting.get(form, [])
                while places and places[-1] in taken:
                    places.pop()
                last = max(last, places[-1] if places else -1)
            if last >= 0:
                pairs[i] = last
                taken.add(last)
        free = [j for j in free if j not in taken]
    return pairs


def meteor_of(reference: str | None, answer: str | None, synonyms: Mapping[str, Collection[str]] | None = None) -> float:
    """Exact matches, then stems, then synonyms; 10PR / (R + 9P), less half the cube of chunks over matches.

    ``synonyms`` gives for a word the sets that it stands in (names of groups of synonyms); without it the third stage is
    left out. Null and empty texts score 0.
    """
    r, a = (re.findall(r"\w+|[^\w\s]", (x or "").lower()) for x in (reference, answer))
    stages: list[Callable[[str], Collection[str]]] = [lambda x: (x,), lambda x: (stemmer(x),)]
    if synonyms:
        stages.append(lambda x: synonyms.get(x, ()))
    pairs = alignment(a, r, stages)
    m = len(pairs)
    if not m:
        return 0.0
    p, q = m / len(a), m / len(r)
    order = sorted(pairs.items())
    chunks = 1 + sum(not (i2 == i1 + 1 and j2 == j1 + 1) for (i1, j1), (i2, j2) in zip(order, order[1:], strict=False))
    return 10 * p * q / (q + 9 * p) * (1 - 0.5 * (chunks / m) ** 3)


def greedy_f1_of(reference: str | None, answer: str | None, encode: Callable[[list[str]], np.ndarray]) -> float:
    """F1 of best cosine matches in both directions between the tokens' vectors."""
    r, a = tokenize(reference, False), tokenize(answer, False)
    if not r or not a:
        return 0.0
    sim = encode(a) @ encode(r).T
    p, q = float(sim.max(axis=1).mean()), float(sim.max(axis=0).mean())
    return 2 * p * q / (p + q) if p + q > 0 else 0.0


def rouge_l(reference: Column, answer: Column, stem: bool = True) -> Column:
    @F.pandas_udf("double")
    def run(r: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series([rouge_l_of(x, y, stem) for x, y in zip(r, a, strict=True)], dtype=float)

    return run(reference, answer)


def meteor(reference: Column, answer: Column, synonyms: Mapping[str, Collection[str]] | None = None) -> Column:
    """meteor_of for each row; a table of synonyms travels with the function, so it is one of a fixed size."""

    @F.pandas_udf("double")
    def run(r: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series([meteor_of(x, y, synonyms) for x, y in zip(r, a, strict=True)], dtype=float)

    return run(reference, answer)


def greedy_f1(reference: Column, answer: Column, encode: Callable[[list[str]], np.ndarray]) -> Column:
    @F.pandas_udf("double")
    def run(r: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series([greedy_f1_of(x, y, encode) for x, y in zip(r, a, strict=True)], dtype=float)

    return run(reference, answer)
