"""Token ids of whole texts by a public tokenizer file, with pieces that recur encoded once a worker.

A tokenizer with the normaliser and pre-tokenizer below splits normalised text into pieces (letters, a digit, other
marks) and merges within a piece only.  For texts of plain Latin characters the split is done here, for a batch at once:
Arrow numbers the batch's distinct pieces, which are looked up among those the worker knows, and those it doesn't
know go to the tokenizer's model together.  Any other text, and every text of any other tokenizer, goes to the
tokenizer as it is.  Ids are the same either way, which tests hold.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa

#: Characters for which lower-casing, NFC and the tokenizer's classes are those of the table of kinds.
PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ÿ]*")
SPACE, LETTER, DIGIT, MARK = range(4)
#: The tokenizer's own classes, for plain text in lower case, a byte a character.
KINDS = np.full(256, MARK, np.uint8)
KINDS[list(b"\t\n\r ")] = SPACE
KINDS[list(b"0123456789")] = DIGIT
KINDS[[*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100)]] = LETTER
#: Letters that make one piece with an apostrophe before them, alone and in pairs.
SHORT, PAIRS = list(b"stmd"), [a << 8 | b for a, b in (b"re", b"ve", b"ll")]
#: The byte-level step shows each byte as a visible character: those that are visible in Latin-1 as they are, the others from U+0100 on.
_VISIBLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}
#: A blank as it is shown, which no piece holds.
BLANK = chr(SHOWN[0x20])
#: The file's parts for which the short way is right.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: Distinct pieces, and bytes in them, that a worker keeps between batches: some 25 MB.
KEPT_PIECES, KEPT_BYTES = 150_000, 8 << 20
#: New pieces that the tokenizer gets at once, and pieces whose ids are put together at once.
LOT, STEP = 1000, 1 << 16
NONE = np.zeros(0, "<u4")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Numbered(dict):
    """A dict that gives a missing key the next number."""

    def __missing__(self, key: bytes) -> int:
        number = self[key] = len(self)
        return number


def pieces(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of plain lower-case text begin, a byte a character; and whether each byte is in a piece."""
    chars = np.frombuffer(text + b"   ", np.uint8)
    kinds = KINDS[chars]
    held = kinds != SPACE
    first = held.copy()
    first[1:] &= (kinds[1:] != kinds[:-1]) | (kinds[1:] == DIGIT)
    at = np.flatnonzero(first & (chars == ord("'")))
    size = np.where(np.isin(chars[at + 1], SHORT), 2, 3 * np.isin(chars[at + 1].astype(np.int64) << 8 | chars[at + 2], PAIRS))
    at, size = at[size > 0], size[size > 0]
    first[at + 1] = False
    first[at + size] |= kinds[at + size] == LETTER
    return np.flatnonzero(first), held[:-3]


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model = told["model"]
        whole = not (model.get("dropout") or model.get("ignore_merges") or told.get("truncation") or told.get("padding"))
        self.split = whole and model["type"] == "BPE" and told["normalizer"] == NORMALIZER and told["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]}
        self.special = [t["content"] for t in told["added_tokens"]]
        self.model = self.tokenizer.model
        # Where all characters have a form for the end of a piece, a piece's last token ends so, and tells pieces put together apart.
        end, vocab = model.get("end_of_word_suffix"), model["vocab"]
        self.together = None
        if self.split and end and all(chr(SHOWN.get(b, b)) + x in vocab for b in range(256) for x in ("", end)):
            self.together = Tokenizer(self.model)
            self.together.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(BLANK)
            self.last = np.zeros(max(vocab.values()) + 1, bool)
            self.last[[i for t, i in vocab.items() if t.endswith(end)]] = True
        self._keep([], NONE, NONE)

    def _keep(self, names: list[bytes], ids: np.ndarray, ends: np.ndarray) -> None:
        """Known pieces: their numbers, ids one after the other, where each number's begin and the last one's end, and whether a later batch had them again."""
        self.numbers, self.size, self.again = _Numbered(zip(names, range(len(names)))), sum(map(len, names)), bytearray(len(names))
        self.ids, self.bounds = array("I", ids.tobytes()), array("q", np.append(0, ends).astype(np.int64).tobytes())

    def _thin(self) -> None:
        """Of too many known pieces, those that came again stay, unless these are too many too."""
        if len(self.numbers) <= KEPT_PIECES and self.size <= KEPT_BYTES:
            return
        names, kept = list(self.numbers), np.flatnonzero(np.frombuffer(self.again, bool))
        names = [names[i] for i in kept.tolist()]
        if not 0 < len(names) <= KEPT_PIECES // 2 or sum(map(len, names)) > KEPT_BYTES // 2:
            self._keep([], NONE, NONE)
        else:
            self._keep(names, self._told(kept), np.cumsum(np.diff(np.frombuffer(self.bounds, np.int64))[kept]))

    def _learn(self) -> None:
        """The ids of pieces that have a number and no ids yet."""
        known = len(self.bounds) - 1
        new = list(islice(reversed(self.numbers), len(self.numbers) - known))[::-1]
        if not new:
            return
        self.size += sum(map(len, new))
        shown = [p.decode() if p.isascii() else p.decode("latin-1").encode().decode("latin-1").translate(SHOWN) for p in new]
        ids = ends = NONE
        if self.together:
            lots = (BLANK.join(shown[i : i + LOT]) for i in range(0, len(shown), LOT))
            ids = np.concatenate([np.array(self.together.encode_batch_fast([x], add_special_tokens=False)[0].ids, np.uint32) for x in lots])
            ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(new):
            each = [[t.id for t in self.model.tokenize(p)] for p in shown]
            ids, ends = np.array([i for x in each for i in x], np.uint32), np.cumsum([len(x) for x in each])
        self.bounds.frombytes((len(self.ids) + ends).astype(np.int64).tobytes())
        self.ids.frombytes(ids.tobytes())
        self.again += bytes(len(new))

    def _told(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of pieces, given by their numbers, one after the other."""
        begins = np.frombuffer(self.bounds, np.int64)[numbers]
        sizes = np.frombuffer(self.bounds, np.int64)[numbers + 1] - begins
        ends = np.cumsum(sizes)
        return np.frombuffer(self.ids, np.uint32)[np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1])]

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each of several plain texts."""
        joined = "\n".join(texts).lower().encode("latin-1")
        starts, held = pieces(joined)
        # Blanks left out, a piece ends where the next one begins.
        offsets = np.cumsum(held, dtype=np.int32)[starts] - 1
        body = np.frombuffer(joined, np.uint8)[held]
        found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(offsets, np.int32(len(body)))), pa.py_buffer(body)]).dictionary_encode()
        distinct = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = len(self.numbers)
        numbers = np.fromiter(map(self.numbers.__getitem__, distinct), np.int64, len(distinct))
        np.frombuffer(self.again, bool)[numbers[numbers < known]] = True
        self._learn()
        numbers, out = numbers[found.indices.to_numpy()], []
        lasts = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in texts])).tolist()
        for a, b in zip([0, *lasts], lasts):
            each = [self._told(numbers[i : min(b, i + STEP)]) for i in range(a, b, STEP)]
            out.append(np.concatenate(each) if len(each) != 1 else each[0]) if each else out.append(NONE)
        self._thin()
        return out

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as little-endian unsigned 32-bit numbers."""
        plain = [self.split and PLAIN.fullmatch(x) is not None and not any(s in x for s in self.special) for x in texts]
        short = iter(self._plain([x for x, p in zip(texts, plain) if p]))
        other = iter(self._whole([x for x, p in zip(texts, plain) if not p]))
        return [next(short) if p else np.frombuffer(next(other), "<u4") for p in plain]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's own encoder for a tokenizer file."""
    return Encoder(path)
