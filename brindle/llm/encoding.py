"""Byte-level BPE encoding of whole texts with the tokenizers library, cached by piece.

A byte-level BPE without normaliser encodes the pieces of its pre-tokenizer one by one.  A blank or
line end between two characters that are not white space always starts a piece, so a text cut there
encodes to the concatenation of its parts.  Each distinct part is encoded by the library once a
worker; texts with other runs of white space go to the library whole.

Most parts are a word, or a word and punctuation: pieces by themselves, as the pre-tokenizer's pattern
takes all letters in a row and then all that is neither letter, digit nor white space.  So the library's
model gets a word once, whatever follows it.

Arrow cuts the texts, numbers their parts and finds those that are known, all by dictionary encoding;
Python handles what is new only."""

from __future__ import annotations

import codecs
import itertools
import json
import os
import re
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words and other parts kept by a worker: those used most, when there are twice as many (about 40 bytes each,
#: thrice that while texts are encoded).  Fewer save memory; they change no result.
CACHE_LIMIT = 200_000
#: Bytes of a part that may be kept; longer ones go when what is kept takes as much as `keep` of twice that.
LONG = 100
#: Characters of texts that are encoded together, as each call goes through all that is kept.
LOT_CHARS = 6 << 20
#: Parts that go to the library in one text.
TOGETHER = 2_000

# Letters are those before U+0250, on which versions of Unicode agree; an apostrophe may begin a piece of letters.
_LETTER, _PUNCTUATION = "[A-Za-zªµºÀ-ÖØ-öø-ɏ]", string.punctuation.replace("'", "")
_LETTERS = "".join(re.findall(_LETTER, "".join(map(chr, range(0x250)))))
_WORD = re.compile(f"\n?{_LETTER}+")
_INSIDE = re.compile(f"[ \n]?{_LETTER}*[{re.escape(_PUNCTUATION)}]*")
# fixed values: the character that stands for each byte in a byte-level vocabulary
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = iter(range(256, 512))
BYTES = "".join(chr(b if b in _PRINTED else next(_OTHERS)) for b in range(256))


class PieceEncoder:
    """encode(texts) -> list of bytes, each the ids of a text as little-endian `dtype`."""

    def __init__(self, path: str, special_as_text: bool = False, keep: int = CACHE_LIMIT):
        self.keep = keep
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = spec["model"]["type"] == "BPE" and spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space", True) and pre.get("use_regex", True)
        # known parts, all different: the ids, whether a text must not be cut there, how often they were met
        self.names, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.uncut, self.uses = np.zeros(0, bool), np.zeros(0, np.int64)
        if self.by_piece:
            # a part begins with a blank or a line end and holds neither elsewhere, so its first token is
            # the only one that begins with one of them
            names = self.tokenizer.get_vocab()
            self.begins = np.zeros(max(names.values()) + 1, bool)
            self.begins[[i for t, i in names.items() if t[0] in "\u0120\u010a"]] = True
            self.line_end = self._library(["\n"])[0]
            self.model = self.tokenizer.model
            # the model knows no added tokens, so none may lie in a word and its punctuation
            self.by_word = not any(_INSIDE.fullmatch(t["content"]) for t in spec.get("added_tokens") or [])

    def _library(self, texts: list[str]) -> list[bytes]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.fromiter((i for x in ids for i in x), self.dtype, sum(map(len, ids))).tobytes()
        out, at, w = [], 0, self.dtype.itemsize
        for x in ids:
            out.append(flat[at : at + w * len(x)])
            at += w * len(x)
        return out

    def _words_and_ends(self, parts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Parts without the punctuation behind a word, and that punctuation; other parts as they are."""
        none = pa.scalar("", pa.large_string())
        if not self.by_word:
            return parts, pa.repeat(none, len(parts))
        # a line end stands at the front of a part only
        end, word = pc.utf8_ltrim(parts, _LETTERS + "\n"), pc.ascii_rtrim(parts, _PUNCTUATION)
        split = pc.and_(pc.equal(pc.ascii_ltrim(end, _PUNCTUATION), none), pc.invert(pc.is_in(word, value_set=pa.array(["", "\n"], pa.large_string()))))
        return pc.if_else(split, word, parts), pc.if_else(split, end, none)

    def _learn(self, names: pa.Array) -> None:
        """Let names, of which the first are known, be the known ones.  Parts with white space at an end
        are marked: a text must not be cut there."""
        new = names.slice(len(self.names)).to_numpy(zero_copy_only=False).tolist()
        found: dict[str, bytes] = {}
        sound, words = [], []
        for p in new:
            if self.by_word and (p.isascii() and p.isalpha() or _WORD.fullmatch(p)):
                words.append(p)
                continue
            body = p[1:] if p[:1] == "\n" else p
            if body and not body[0].isspace() and not body[-1].isspace():
                sound.append(p)
        self._words(words, found)
        for lo in range(0, len(sound), 10 * TOGETHER):
            groups = [sound[k : k + TOGETHER] for k in range(lo, min(lo + 10 * TOGETHER, len(sound)), TOGETHER)]
            full = [[p if p[0] == "\n" else " " + p for p in g] for g in groups]
            for g, f, e in zip(groups, full, self.tokenizer.encode_batch_fast(["".join(f) for f in full], add_special_tokens=False)):
                ids = np.array(e.ids, self.dtype)
                at = np.flatnonzero(self.begins[ids]).tolist()
                if len(at) != len(g):
                    found.update(zip(g, self._library(f)))
                    continue
                flat, w = ids.tobytes(), self.dtype.itemsize
                found.update((p, flat[w * x : w * y]) for p, x, y in zip(g, at, [*at[1:], len(ids)]))
        ids = pa.array(list(map(found.get, new)), pa.large_binary())
        self.names, self.ids = names, pa.concat_arrays([self.ids, ids.fill_null(b"")])
        self.uncut = np.append(self.uncut, ids.is_null().to_numpy(zero_copy_only=False))
        self.uses = np.append(self.uses, np.zeros(len(ids), np.int64))

    def _words(self, words: list[str], found: dict[str, bytes]) -> None:
        """Put parts of letters alone into found, by the model itself."""
        tokenize, size = self.model.tokenize, self.dtype.itemsize
        for lo in range(0, len(words), 10 * TOGETHER):
            some = words[lo : lo + 10 * TOGETHER]
            plain = "\n".join([w[1:] if w[0] == "\n" else " " + w for w in some])
            ids = [[t.id for t in tokenize(w)] for w in codecs.charmap_decode(plain.encode(), "strict", BYTES)[0].split(BYTES[10])]
            flat, at = np.fromiter(itertools.chain.from_iterable(ids), self.dtype).tobytes(), 0
            for w, x in zip(some, ids):
                end = at + size * len(x)
                found[w] = self.line_end + flat[at:end] if w[0] == "\n" else flat[at:end]
                at = end

    def _forget(self) -> None:
        """Keep the parts used most, none of more than LONG bytes; what was used long ago counts less."""
        some = np.flatnonzero(pc.binary_length(self.names).to_numpy() <= LONG)
        if len(some) > self.keep:
            some = np.sort(some[np.argpartition(self.uses[some], -self.keep)[-self.keep :]])
        self.names, self.ids = self.names.take(pa.array(some)), self.ids.take(pa.array(some))
        self.uncut, self.uses = self.uncut[some], self.uses[some] // 2

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_piece or not texts:
            return self._library(texts)
        if len(self.names) > 2 * self.keep or self.names.nbytes + self.ids.nbytes > 2 * self.keep * LONG:
            self._forget()
        # a part is `\nword`, or `word` that follows a blank; the first gets a line end in front
        lines = pc.split_pattern(pa.array(["\n" + t.replace("\n", " \n") for t in texts], pa.large_string()), " ")
        bounds, parts = lines.offsets.to_numpy(), lines.values.dictionary_encode()
        words, ends = self._words_and_ends(parts.dictionary)
        coded, known = pa.concat_arrays([self.names, words]).dictionary_encode(), len(self.names)
        self._learn(coded.dictionary)
        which, ends = coded.indices.slice(known), ends.dictionary_encode()
        self.uses += np.bincount(which.to_numpy(), minlength=len(self.uses))
        tails = pa.array(self._library(ends.dictionary.to_pylist()), pa.large_binary())
        ids = pc.binary_join_element_wise(self.ids.take(which), tails.take(ends.indices), pa.scalar(b"", pa.large_binary()))
        _, at, data = ids.take(parts.indices).buffers()
        at, data = np.frombuffer(at, np.int64)[bounds], memoryview(data or b"")
        skip = len(self.line_end)
        out = [bytes(data[x + skip : y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
        uncut = np.flatnonzero(self.uncut[which.to_numpy()])
        if len(uncut):
            rows = np.flatnonzero(np.isin(parts.indices.to_numpy(), uncut))
            for k in np.unique(np.searchsorted(bounds, rows, "right") - 1).tolist():
                out[k] = self._library([texts[k]])[0] if texts[k] else b""
        return out


_ENCODERS: dict[tuple, PieceEncoder] = {}


def encoder(path: str, special_as_text: bool = False, keep: int = CACHE_LIMIT) -> PieceEncoder:
    """One encoder a worker process: that asked for last."""
    key = (path, special_as_text, keep)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = PieceEncoder(path, special_as_text, keep)
    return _ENCODERS[key]


def lots(batches, limit: int = LOT_CHARS):
    """(ids, texts) of batches of these two columns, row after row, up to `limit` characters together (or one
    longer text); null texts are empty."""
    ids, texts, total = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            size = len(t or "") + 32  # what a row takes besides
            if total and total + size > limit:
                yield ids, texts
                ids, texts, total = [], [], 0
            ids.append(i)
            texts.append(t or "")
            total += size
    if ids:
        yield ids, texts


def slices(sizes, limit: int):
    """Bounds of runs of items of at most `limit` in sum (or one larger item)."""
    lo, total = 0, 0
    for k, s in enumerate(sizes):
        if total and total + s > limit:
            yield lo, k
            lo, total = k, 0
        total += s
    if lo < len(sizes):
        yield lo, len(sizes)
