"""Tokens of normalised names: a left-to-right scan, then a least-cost cover of CJK runs by dictionary
words.  The scan carries state from character to character, so it runs as an Arrow-batched function
with the dictionaries in its closure (word lists; their size is checked)."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.specs import N, UNITS
from brindle.functions.text import LOOSE, MORE_COUNTERS, WEIGHING_TERMS

# fixed values
NOISE = set("*/\\+-~|、，。")
LEGAL_SINGLES = set(
    "大中小" "米粉糖盐油酱醋茶酒" "肉鱼虾蛋奶豆面饭" "瓜果菜花叶根茎" "块片条粒丝丁末浆汁" "丸糕饼冻干鲜熟生泡"
    "箱包袋瓶罐盒桶杯碗盘" "个只份组套排串把张" "号型级等装味香辣" "口"
)
MAX_WORDS = 200_000

_CJK = "[一-鿿]"
_QUANTITY = re.compile(rf"{N}(?:g|mL|kg|ml|L|斤|两|克|磅|盎司|lb|oz|cm|mm|dm|m)", re.I)
_COUNTED = re.compile(rf"{N}[{MORE_COUNTERS}]")
_PIECE = re.compile(rf"{N}|{_CJK}+|[a-zA-Z]+|\S")
_PLAIN = re.compile(rf"{N}\Z")
_JOINS = re.compile(rf"(?:{UNITS})\Z", re.I)
_COUNTER = re.compile(f"[{MORE_COUNTERS}]\\Z")


class Lexicon:
    """Words by first character, longest first."""

    def __init__(self, words: Iterable[str]):
        self.words = {w for w in words if w}
        if len(self.words) > MAX_WORDS:
            raise ValueError(f"a dictionary of {len(self.words)} words; {MAX_WORDS} at most go into a function's closure")
        self.lengths = defaultdict(set)
        for w in self.words:
            self.lengths[w[0]].add(len(w))
        self.lengths = {c: sorted(v, reverse=True) for c, v in self.lengths.items()}

    def at(self, text: str, k: int):
        """Words that begin at k, longest first."""
        for n in self.lengths.get(text[k], ()):
            if k + n <= len(text) and text[k : k + n] in self.words:
                yield text[k : k + n]


class Tokenizer:
    """fallback: another segmenter for CJK runs; without one the cover stands."""

    def __init__(self, brands: Iterable[str] = (), spec_words: Iterable[str] = (), fallback: Callable[[str], list[str]] | None = None):
        self.brands, self.specs, self.fallback = Lexicon(brands), Lexicon(spec_words), fallback

    def __call__(self, name: str | None) -> list[str]:
        out: list[str] = []
        for piece in self._scan((name or "").strip()):
            run = len(piece) > 1 and re.fullmatch(f"{_CJK}+", piece)
            out += self.split(piece) if run else [piece]
        joined: list[str] = []
        held = iter(range(len(out)))
        for k in held:
            after = out[k + 1] if k + 1 < len(out) else ""
            if _PLAIN.match(out[k]) and (_JOINS.match(after) or _COUNTER.match(after)):
                joined.append(out[k] + after)
                next(held)
            else:
                joined.append(out[k])
        return [LOOSE if t in WEIGHING_TERMS else t for t in joined if t not in NOISE]

    def _scan(self, text: str):
        k = 0
        while k < len(text):
            if text[k].isspace():
                k += 1
                continue
            hit = _QUANTITY.match(text, k) or _COUNTED.match(text, k)
            piece = hit[0] if hit else None
            if piece is None and not text[k].isdigit():
                piece = self._brand(text, k)
            if piece is None:
                piece = _PIECE.match(text, k)[0]
            yield piece
            k += len(piece)

    def _brand(self, text: str, k: int) -> str | None:
        """The longest brand at k; one of a single character only if a known word or no CJK follows."""
        for b in self.brands.at(text, k):
            after = text[k + 1 : k + 2]
            if len(b) > 1 or not re.match(_CJK, after) or after in self.specs.words:
                return b
        return None

    def split(self, run: str) -> list[str]:
        if run in self.specs.words:
            return [run]
        cover = self.cover(run)
        orphans = any(len(t) == 1 and t not in self.specs.words and t not in LEGAL_SINGLES for t in cover)
        if self.fallback and (cover == [run] or orphans):
            other = [t for t in self.fallback(run) if t.strip()]
            if other and other != [run] and (cover == [run] or self.hits(other) > self.hits(cover)):
                return other
        return cover

    def hits(self, tokens: list[str]) -> int:
        return sum(2 if t in self.specs.words else int(t in LEGAL_SINGLES) for t in tokens)

    def cover(self, run: str) -> list[str]:
        """Fewest characters outside words, then the longest longest word, then the fewest words; ties
        go to leaving a character out, then to the longer word.  Characters left out side by side are
        one token."""
        best: list[tuple] = [((0, 0, 0), None)] * (len(run) + 1)
        for k in range(len(run) - 1, -1, -1):
            left, longest, count = best[k + 1][0]
            ways = [((left + 1, longest, count), None)]
            for w in self.specs.at(run, k):
                left, longest, count = best[k + len(w)][0]
                ways.append(((left, min(longest, -len(w)), count + 1), w))
            best[k] = min(ways, key=lambda way: way[0])
        out, k, loose = [], 0, False
        while k < len(run):
            word = best[k][1]
            if word is None and loose:
                out[-1] += run[k]
            else:
                out.append(word or run[k])
            loose = word is None
            k += len(word or run[k])
        return out


def tokenize(brands: Iterable[str] = (), spec_words: Iterable[str] = (), fallback: Callable[[str], list[str]] | None = None) -> Callable[[Column], Column]:
    """Column function: normalised name -> array of tokens ([] for null).  fallback: another segmenter, asked
    where the cover finds no word or leaves single characters out."""
    tokenizer = Tokenizer(brands, spec_words, fallback)

    @F.pandas_udf("array<string>")
    def run(names: pd.Series) -> pd.Series:
        return names.map(tokenizer, na_action=None)

    return lambda c: run(F.coalesce(c, F.lit("")))


def attribute_finder(detail_words: Iterable[str]) -> Callable[[str], list[str]]:
    """name -> dictionary words in it, longest first and without overlap, in order of position."""
    words = sorted({w for w in detail_words if w}, key=lambda w: (-len(w), w))
    Lexicon(words)

    def find(name: str) -> list[str]:
        taken, found = bytearray(len(name)), []
        for w in words:
            at = name.find(w)
            while at >= 0:
                if not any(taken[at : at + len(w)]):
                    taken[at : at + len(w)] = b"\1" * len(w)
                    found.append((at, w))
                at = name.find(w, at + 1)
        return [w for _, w in sorted(found)]

    return find


def attributes(detail_words: Iterable[str]) -> Callable[[Column], Column]:
    """Column function: attribute_finder() of a raw name.  Longest-first over the whole text is not what a
    regex alternation finds."""
    find = attribute_finder(detail_words)

    @F.pandas_udf("array<string>")
    def run(names: pd.Series) -> pd.Series:
        return names.map(find)

    return lambda c: run(F.coalesce(c, F.lit("")))
