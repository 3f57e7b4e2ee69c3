"""Byte-level BPE ids of whole texts, many texts at a time and each distinct piece of them once.

The ids are those of the tokenizers library on the whole text. Its pattern always starts a new word
at a blank that is followed by something else than white space, so a text may be cut there. The
pieces of a run of texts are numbered by Arrow, only distinct ones are encoded, and the ids of the
texts are gathered by number. Pieces of common Latin letters, digits and signs are cut into words
and merged together in numpy, by the merges of the library's vocabulary; any other piece goes
through the library, and so does, whole, a text that holds an added token such as <|endoftext|>
where those are asked for.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lumencat.llm.textvec import stretches, text_bytes

# Classes of bytes, by which the pattern of the public byte-level vocabulary cuts words: letters, digits,
# signs and a line feed. An apostrophe may begin a word of its own, so pieces with one, and with bytes
# of no class, go to the library. C3 to C8 begin letters of Latin alphabets, but for two signs.
_LETTER, _DIGIT, _SIGN, _LINE = 1, 2, 3, 4
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = _SIGN
_CLASS[ord("'")] = 0
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0xC0), *range(0xC3, 0xC9)]] = _LETTER
_CLASS[ord("\n")] = _LINE
_SIGNS_IN_LETTERS = (0x97, 0xB7)
#: Bytes of text whose pieces are numbered together.
RUN = 1 << 23


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if printable, else 256 + n."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in printable}
    for n, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + n)
    return [letters[b] for b in range(256)]


class Merges:
    """The merges of a vocabulary, applied to many words at once."""

    def __init__(self, vocab: dict[str, int], merges: Sequence):
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys = np.concatenate([keys[order], [np.iinfo(np.int64).max]])
        self.ranks = np.concatenate([order, [0]]).astype(np.int32)
        self.made = np.array([vocab["".join(p)] for p in pairs], np.int32)
        self.never = np.int32(len(pairs))
        self.of_byte = np.array([vocab[letter] for letter in _byte_letters()], np.int32)
        byte = self.of_byte.astype(np.int64)
        self.first = self._rank(np.repeat(byte, 256), np.tile(byte, 256)).reshape(256, 256)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair among the merges; ``never`` if it is none."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], self.never)

    def ids(self, data: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, the word of each) of bytes and the number of the word of each byte, rising.

        In every round each word makes its next merge; words without one are done.
        """
        ids = self.of_byte[data]
        rank = np.full(len(ids), self.never)  # of each id with the next one of its word
        inside = word[1:] == word[:-1]
        rank[:-1][inside] = self.first[data[:-1][inside], data[1:][inside]]
        done_ids, done_word = [], []
        while len(ids):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, starts)
            spread = np.repeat(least, np.diff(np.append(starts, len(ids))))
            ended = spread == self.never
            done_ids.append(ids[ended])
            done_word.append(word[ended])
            ids, word, rank, spread = ids[~ended], word[~ended], rank[~ended], spread[~ended]
            if not len(ids):
                break
            at = np.flatnonzero(rank == spread)
            at = at[np.concatenate([[True], word[at[1:]] != word[at[:-1]]])]  # the leftmost of each word
            ids[at] = self.made[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))  # one id fewer for each merge before it
            ids, word = ids[keep], word[keep]
            rank[np.flatnonzero(~keep) - 1] = rank[~keep]
            rank = rank[keep]
            for left in (at - 1, at):
                left = left[(left >= 0) & (left + 1 < len(ids))]
                left = left[word[left] == word[left + 1]]
                rank[left] = self._rank(ids[left], ids[left + 1])
        ids, word = np.concatenate(done_ids or [ids]), np.concatenate(done_word or [word])
        order = np.argsort(word, kind="stable")
        return ids[order], word[order]


class Encoder:
    """Encodes texts to little-endian ids of ``dtype``. Keeps nothing between calls."""

    def __init__(self, path: str, added_tokens: bool = False):
        """``added_tokens`` as in the library by default: texts that spell one out hold its id."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added_tokens
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if added_tokens else []
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        model = json.loads(self.tokenizer.to_str())["model"]
        self.merges = Merges(model["vocab"], model["merges"])

    def _library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def whole(self, text: str) -> bytes:
        return np.array(self._library(text), self.dtype).tobytes()

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids end to end, how many each piece has with a blank before it, whether it is no cut)."""
        data, begins = text_bytes(pieces)
        sizes = np.diff(begins)
        # Each piece with a blank before it.
        starts = begins[:-1] + np.arange(len(sizes))
        blanked = np.full(len(data) + len(sizes), ord(" "), np.uint8)
        inside = np.ones(len(blanked), bool)
        inside[starts] = False
        blanked[inside] = data
        piece = np.repeat(np.arange(len(sizes)), sizes + 1)
        kind = _CLASS[blanked]
        odd = (kind == 0) & inside
        odd[1:] |= (blanked[:-1] == 0xC3) & np.isin(blanked[1:], _SIGNS_IN_LETTERS)
        line = blanked == ord("\n")
        odd |= line & np.append(line[1:] | ~inside[1:], True)  # before white space or the end
        odd[1:] |= line[1:] & ~inside[:-1]  # after the blank
        slow = np.zeros(len(sizes), bool)
        slow[piece[odd]] = True
        slow |= sizes == 0
        change = np.ones(len(blanked), bool)
        change[1:] = kind[1:] != kind[:-1]
        change[starts] = True
        change[starts[sizes > 0] + 1] = False  # the blank goes with what follows
        fast = ~slow[piece]
        word = np.cumsum(change)[fast]
        ids, of = self.merges.ids(blanked[fast], word)
        owner = np.zeros(int(word[-1]) + 1 if len(word) else 1, np.int64)
        owner[word] = piece[fast]
        counts = np.bincount(owner[of], minlength=len(sizes))
        uncut = np.zeros(len(sizes), bool)
        places, known = np.flatnonzero(slow), []
        for n in places.tolist():
            text = pieces[n].as_py()
            uncut[n] = not text or text[0].isspace()
            known.append([] if uncut[n] else self._library(" " + text))
        if known:
            extra = np.fromiter(map(len, known), np.int64, len(known))
            ids = np.concatenate([ids, np.fromiter((i for row in known for i in row), np.int32, int(extra.sum()))])
            owners = np.concatenate([owner[of], np.repeat(places, extra)])
            ids, counts = ids[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(sizes))
        return ids.astype(self.dtype), counts, uncut

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text; null is empty."""
        for run in stretches(texts.cast(pa.large_string()), RUN):
            yield from self._run(run.fill_null(""))

    def _run(self, texts: pa.Array) -> Iterator[bytes]:
        lists = pc.split_pattern(texts, " ")
        begins = lists.offsets.to_numpy()
        pieces = lists.values.dictionary_encode()
        index, distinct = pieces.indices.to_numpy(), pieces.dictionary
        ids, sizes, uncut = self._pieces(distinct)
        # A blank before white space or the end is no cut: such texts, and those with added tokens, go whole.
        uncut = uncut[index]
        uncut[begins[:-1]] = False
        whole = np.logical_or.reduceat(uncut, begins[:-1])
        for content in self.added:
            whole |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        starts = np.cumsum(sizes) - sizes
        n = sizes[index]
        n[begins[:-1]] = 0  # the first piece has no blank before it
        ends = np.concatenate([[0], np.cumsum(n)])
        gathered = ids[np.repeat(starts[index] - ends[:-1], n) + np.arange(ends[-1])]
        borders = ends[begins]
        for k, text_whole in enumerate(whole.tolist()):
            if text_whole:
                yield self.whole(texts[k].as_py())
            else:
                first = distinct[index[begins[k]]].as_py()
                yield (self.whole(first) if first else b"") + gathered[borders[k] : borders[k + 1]].tobytes()

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all(pa.array([text], pa.string())))
