"""Whole-text tokenization by the tokenizers library, a piece of text once a batch.

A text is cut only where every one of the tokenizer's own pre-tokens ends as well, so the ids of
the pieces, joined, are the ids of the whole text. The distinct pieces of a batch are encoded by the library, plain
words many to a call, and put together by their numbers; nothing is kept from batch to batch.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import rows_of

#: Bytes of text of a batch: the more, the fewer pieces are encoded again.
BATCH = 6 << 20
#: Plain words of a call.
CALL = 512
_ODD = re.compile(r"[^\S\n ]|.\n", re.S).search
#: Letters of ASCII and Latin-1, which no tokenizer's pattern cuts and no normalizer changes (those in lower case).
_LETTERS, _LOWER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "a-z\xdf-\xf6\xf8-\xff"
#: Runs of these between a letter and the end of a word are a pre-token of their own.
_TAIL = r"!\"#$%&()*+,\-./:;<=>?@\[\]^_`{|}~"
#: Before the first piece of a text, between words of a call, and before such a run.
_START, _MARK, _PART = "\0", "\x01", "\x02"


class Encoder:
    """encode(texts) -> for each text the little-endian ids as bytes, of self.dtype.

    In the pieces of a byte-level tokenizer a word stands for itself after a space, one
    after "\\n" for a line's first word with the line break, and one after NUL for itself. Texts with other or
    repeated white space are encoded by the library as they are; so are texts with the marks of pieces, and those that hold the name of a
    special token, which is that token (the library's default) unless ``plain_specials``.
    """

    def __init__(self, path: str, plain_specials: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        spec = json.loads(self.tokenizer.to_str())
        names = [x["content"] for x in spec.get("added_tokens") or [] if not (plain_specials and x["special"])]
        # what has none of these bytes needs no closer look; names count in any case, as a normalizer may change it
        head = re.match("[^A-Za-z]*", os.path.commonprefix(names)).group() if names else ""
        self.signs = [x.encode() for x in (_START, _MARK, _PART, *([head] if head else []))]
        self.always = bool(names) and not head
        self.strange = "(?i)" + "|".join([f"[{_START}{_MARK}{_PART}]".replace("\0", r"\x00"), *map(re.escape, names)])
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        steps = [x.get("type") for x in (norm or {}).get("normalizers", [])]
        self.odd = False
        if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and norm is None:
            self.cut, self.learn, self.odd = self._cut_bytes, self._learn_bytes, True
            self.plain, self.starts = f"^[{_LETTERS}]+$", True
            self.flags = np.zeros(size, bool)
            self.flags[[i for x, i in self.tokenizer.get_vocab().items() if x[0] == "Ġ"]] = True
            self.breaks = np.arange(size) == self._one("\n")
            self.slim = self._slim(path, "merged_with_next")
        elif steps == ["NFC", "Replace", "Lowercase"] and spec["model"].get("end_of_word_suffix") and pre["pretokenizers"][0]["behavior"] == "Removed":
            self.cut, self.learn = self._cut_words, self._learn_words
            self.plain, self.starts = f"^[{_LOWER}]+$", False
            self.marks = np.arange(size) == self._one(_MARK)
            self.flags = np.zeros(size, bool)
            self.flags[[i for x, i in self.tokenizer.get_vocab().items() if x.endswith(spec["model"]["end_of_word_suffix"])]] = True
            self.slim = self._slim(path, "removed")
        else:
            self.cut = None

    @staticmethod
    def _slim(path: str, behavior: str):
        """The tokenizer without the steps that leave plain words as they are."""
        from tokenizers import Tokenizer, pre_tokenizers

        slim = Tokenizer.from_file(path)
        slim.normalizer = None
        slim.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", behavior), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False, trim_offsets=False)])
        slim.model._resize_cache(0)  # every word that comes here is new
        return slim

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _one(self, text: str) -> int:
        ids = np.frombuffer(self._ids([text])[0], self.dtype)
        return int(ids[0]) if len(ids) == 1 else -1

    def _plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words, one after another, and how many each has; words begin (or end) at the ids that say so."""
        calls = pa.ListArray.from_arrays(pa.array([*range(0, len(words), CALL), len(words)], pa.int32()), words)
        texts = pc.binary_join(calls, pa.scalar(" ", words.type)).to_pylist()
        ids, sizes = [np.empty(0, self.dtype)], [np.empty(0, np.int64)]
        for k in range(0, len(texts), 64):
            for i, e in enumerate(self.slim.encode_batch_fast([" " * self.starts + x for x in texts[k : k + 64]], add_special_tokens=False), k):
                own = np.array(e.ids, self.dtype)
                at = np.flatnonzero(self.flags[own])
                if len(at) != min(CALL, len(words) - i * CALL):
                    raise ValueError("the tokenizer does not keep words apart")
                ids.append(own)
                sizes.append(np.diff(np.append(at, len(own))) if self.starts else np.diff(at, prepend=-1))
        return np.concatenate(ids), np.concatenate(sizes)

    def _many(self, words: list[str], sep: str, first: bool, parts: np.ndarray) -> dict[str, bytes]:
        """Encodes words joined by sep (``first``: also before the first), parted at the ids marked in ``parts``:
        a call for each word would cost more than its encoding. sep's own ids belong to a word only if ``first``."""
        out, width = {}, self.dtype.itemsize
        for i in range(0, len(words), CALL):
            some = words[i : i + CALL]
            ids = np.frombuffer(self._ids([sep * first + sep.join(some)])[0], self.dtype)
            at = np.flatnonzero(parts[ids])
            if first:
                starts, ends, good = at.tolist(), [*at[1:].tolist(), len(ids)], len(at) == len(some)
            else:
                starts, ends, good = [0, *(at + 1).tolist()], [*at.tolist(), len(ids)], len(at) == len(some) - 1
            if good:
                raw = ids.tobytes()
                out |= {x: raw[a * width : b * width] for x, a, b in zip(some, starts, ends)}
            else:
                out |= zip(some, self._ids([sep * first + x for x in some]))
        return out

    @staticmethod
    def _part(texts: pa.Array) -> pa.Array:
        return pc.replace_substring_regex(texts, f"([{_LETTERS}])([{_TAIL}]+)( |$)", rf"\1 {_PART}\2\3")

    def _cut_bytes(self, texts: pa.Array) -> pa.Array:
        """Every pre-token ends before a space that follows a character other than white space, and a lone line
        break between other characters is a pre-token."""
        lines = self._part(pc.replace_substring(texts, "\n", " \n"))
        text = pa.scalar("", pa.large_string())
        return pc.split_pattern(pc.binary_join_element_wise(pa.scalar(_START, pa.large_string()), lines, text), " ")

    @staticmethod
    def _strange_space(pieces: list[str]) -> set[str]:
        """Pieces that tell of white space that does not stand alone, or of other white space."""
        return {x for x in pieces if not x or x == "\n" or _ODD(x[1:]) or (x[0].isspace() and x[0] != "\n")}

    def _cut_words(self, texts: pa.Array) -> pa.Array:
        """White space only parts words, and ASCII letters are lower-cased anyway."""
        spaced = pc.replace_substring_regex(pc.ascii_lower(texts), r"[\t\n\x0b\f\r]", " ")
        return pc.ascii_split_whitespace(self._part(spaced))

    def _learn_bytes(self, pieces: list[str]) -> list[bytes]:
        alone = list({x[1:] for x in pieces if x[0] in "\0\n\x02"} - {""})
        got = {"": b""} | self._many(alone, "\n", False, self.breaks)
        after = self._many([x for x in pieces if x[0] not in "\0\n\x02"], " ", True, self.flags)
        line = self._ids(["\n"])[0]
        return [after[x] if x[0] not in "\0\n\x02" else (line if x[0] == "\n" else b"") + got[x[1:]] for x in pieces]

    def _learn_words(self, pieces: list[str]) -> list[bytes]:
        bare = [x.lstrip(_PART) for x in pieces]
        got = {"": b""} | self._many(list(set(bare) - {""}), f" {_MARK} ", False, self.marks)
        return [got[x] for x in bare]

    def encode(self, texts) -> list[bytes]:
        texts = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        if self.cut is None:
            return self._ids(texts.to_pylist())
        # a copy of its own: of a slice, Arrow's ascii_lower keeps the offsets of the whole, which lie beyond the bytes it makes
        texts = texts.take(pa.array(np.arange(len(texts))))
        raw = texts.buffers()[2]
        raw = raw.to_pybytes() if raw else b""
        if not self.always and not any(raw.find(x) >= 0 for x in self.signs):
            return self._pieces(texts)
        strange = pc.match_substring_regex(texts, self.strange)
        out = self._pieces(pc.if_else(strange, "", texts))
        rows = np.flatnonzero(strange.to_numpy(zero_copy_only=False)).tolist()
        for i, ids in zip(rows, self._ids([texts[i].as_py() for i in rows])):
            out[i] = ids
        return out

    def _pieces(self, texts: pa.Array) -> list[bytes]:
        """The pieces are made and numbered by Arrow; plain words are not even seen by Python."""
        pieces = self.cut(texts)
        ends = pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
        coded = pieces.flatten().dictionary_encode()
        unique, at = coded.dictionary, coded.indices.to_numpy()
        plain = pc.match_substring_regex(unique, self.plain)
        ids, own = self._plain(unique.filter(plain))
        plain = plain.to_numpy(zero_copy_only=False)
        rest = unique.filter(pa.array(~plain)).to_pylist()
        odd = self._strange_space(rest) if self.odd else set()
        known = dict(zip(some, self.learn(some))) if (some := [x for x in rest if x not in odd]) else {}
        rest_ids = [known.get(x, b"") for x in rest]
        width = self.dtype.itemsize
        flat = np.concatenate([ids, np.frombuffer(b"".join(rest_ids), self.dtype)])
        sizes, starts = np.zeros(len(unique), np.int64), np.zeros(len(unique), np.int64)
        sizes[plain], sizes[~plain] = own, np.fromiter(map(len, rest_ids), np.int64, len(rest_ids)) // width
        for where, base in ((plain, 0), (~plain, len(ids))):
            starts[where] = base + np.cumsum(sizes[where]) - sizes[where]
        own = sizes[at]
        stops = np.cumsum(own)
        total = int(stops[-1]) if len(stops) else 0
        raw = flat[np.repeat(starts[at] - (stops - own), own) + np.arange(total)].tobytes()
        bounds = (np.concatenate([[0], stops])[ends] * width).tolist()
        out = [raw[a:b] for a, b in zip(bounds, bounds[1:])]
        if odd:
            strange = np.zeros(len(unique), bool)
            strange[np.flatnonzero(~plain)[[x in odd for x in rest]]] = True
            seen = np.concatenate([[0], np.cumsum(strange[at])])[ends]
            for i in np.flatnonzero(np.diff(seen)).tolist():
                out[i] = self._ids([texts[i].as_py()])[0]
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker, kept over its tasks."""
    return Encoder(path)


def gathered(batches, most_bytes: int = BATCH, column: str = "text"):
    """Arrow batches put together, or cut, to about so many bytes of text."""
    held, size = [], 0
    for batch in batches:
        for part in rows_of(batch, most_bytes, column):
            held.append(part)
            size += part.column(column).nbytes
            if size >= most_bytes:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
