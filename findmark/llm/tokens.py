"""Token ids of whole texts, by the tokenizers library.

A byte-level tokenizer of this kind first cuts a text into pieces and never joins across them.  A single blank between two
characters that are no white space always begins a piece, and so does every change between a letter and a mark that is
neither a letter, a digit, white space nor an apostrophe, and every single line feed between such characters.  So texts are
cut there, each distinct part is encoded by the tokenizer and kept in a bounded cache, and a text's ids are those of its
parts in order.  ``tests/llm`` compares this with whole texts encoded in one call.  A tokenizer of another kind (any other
pre-tokenizer, a normalizer, or a byte-level one without its pattern) is found when it is loaded, and gets whole texts.

A second kind, of words, lower-cases a text, drops its white space and takes letters, single digits and other marks apart.  No
part of it holds white space, nor a letter and a mark after it, so these texts are cut at blanks, line feeds and between a
letter and a mark, and the parts are encoded and kept in the same way.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from findmark.llm.shared import kept, spare_memory

#: Distinct parts of texts kept in each of the two halves of a worker's cache.
CACHE_PARTS = 250_000
#: Bytes of text that are cut and looked up at once; a longer text is taken alone.
SLICE = 4 << 20
#: Texts with these are cut by a slower pattern: white space beside white space or at an end, rare white space, \x01.
_SLOW = "<[|]|  | \n|\n |\n\n|\n$|^ | $"
_RARE = "[\t\r\x01\x0b\x0c\x1c-\x1f\u0085\u00a0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]"
#: Fixed value: the pattern of the tokenizers of words that are known to be cut in this way.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SINGLE_BLANK = re.compile(r"(?<=\S) (?=\S)")
#: Without U+0130, whose lower case ends in a combining mark.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"


class _Cache(dict):
    """Two generations: what was used lately survives when the other half is dropped."""

    def __init__(self):
        self.old: dict = {}

    def missing(self, keys: list) -> list:
        if len(self) > CACHE_PARTS:
            self.old = dict(self)
            self.clear()
        out = []
        for k in keys:
            if k not in self:
                if (v := self.old.get(k)) is None:
                    out.append(k)
                else:
                    self[k] = v
        return out


class Encoder:
    """Arrays of texts to ids, with ``end_id`` after each text."""

    def __init__(self, path: str, end_id: int = 0):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size, self.end_id = max(vocab.values()) + 1, end_id
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        made = json.loads(self.tokenizer.to_str())
        before = made.get("pre_tokenizer") or {}
        self.cuts = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not made.get("normalizer")
        self.words = self._of_words(made)
        self.blank, self.feed, self.last = (np.zeros(self.size, bool) for _ in "ĠĊ/")
        for k, i in vocab.items():
            self.blank[i], self.feed[i], self.last[i] = k[:1] == "Ġ", k[:1] == "Ċ", k.endswith("</w>")
        self.parts = _Cache()

    @staticmethod
    def _of_words(made: dict) -> bool:
        """Whether white space is dropped and each change from a letter to a mark ends a part."""
        split = ((made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        ways = (made.get("normalizer") or {}).get("normalizers") or []
        plain = all(w["type"] in ("NFC", "Lowercase") or (w["type"], w.get("pattern"), w.get("content")) == ("Replace", {"Regex": r"\s+"}, " ") for w in ways)
        whole = not any(a["content"].split() != [a["content"]] or a["single_word"] for a in made.get("added_tokens") or [])
        return plain and whole and (split.get("behavior"), split.get("invert"), split.get("pattern")) == ("Removed", True, {"Regex": _WORDS})

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _learn(self, parts: list[str]) -> None:
        """Encodes the parts that the cache lacks, many in one call where the ids show where each begins."""
        missing = self.parts.missing(parts)
        if self.words:
            for at in range(0, len(missing), 10_000):
                self._learn_words(missing[at : at + 10_000])
            return
        plain = {p for p in missing if p and "\n" not in p and "<|" not in p and " " not in p[1:]}
        for p in missing:
            if p not in plain:
                self.parts[p] = self._ids(p).tobytes()
        for begins, lead, own in ((self.blank, "", [p for p in plain if p[0] == " "]), (self.feed, "\n", [p for p in plain if p[0] != " "])):
            for at in range(0, len(own), 10_000):
                some = own[at : at + 10_000]
                ids = self._ids("".join(lead + p for p in some))
                first = np.flatnonzero(begins[ids])
                if len(first) != len(some):
                    self.parts.update((p, self._ids(p).tobytes()) for p in some)
                    continue
                raw, skip, w = ids.tobytes(), self.kind.itemsize * len(lead), self.kind.itemsize
                self.parts.update((p, raw[a + skip : b]) for p, a, b in zip(some, (first * w).tolist(), np.append(first[1:] * w, len(raw)).tolist()))

    def _learn_words(self, parts: list[str]) -> None:
        """The same for parts without blanks: those of letters alone are encoded in one text, where each has one last id."""
        letters = [p for p in parts if p.isalpha()]
        ids = self._ids(" ".join(letters))
        last = np.flatnonzero(self.last[ids])
        if len(last) == len(letters):
            raw, upto = ids.tobytes(), ((last + 1) * self.kind.itemsize).tolist()
            self.parts.update((p, raw[a:b]) for p, a, b in zip(letters, [0, *upto], upto))
            parts = [p for p in parts if not p.isalpha()]
        self.parts.update((p, np.array(e.ids, self.kind).tobytes()) for p, e in zip(parts, self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, ends)``: ids (of ``kind``) of all texts one after another, and where each text's ids end; null is empty."""
        all_ids, all_ends, total = [np.zeros(0, self.kind)], [np.zeros(0, np.int64)], 0
        for _, ids, ends in self.slices(texts):
            all_ids.append(ids)
            all_ends.append(ends + total)
            total += len(ids)
        return np.concatenate(all_ids), np.concatenate(all_ends)

    def slices(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(first, ids, ends)`` of slices of ``texts``, one after another: the number of a slice's first text, and as in ``encode``."""
        upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = np.flatnonzero(np.append(True, upto[1:] // SLICE != upto[:-1] // SLICE)) if len(texts) else np.zeros(0, np.int64)
        for a, b in zip(begin.tolist(), np.append(begin[1:], len(texts)).tolist()):
            yield a, *self._encode(pc.fill_null(texts[a:b].cast(pa.large_string()), ""))
            spare_memory()

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for a slice without nulls."""
        if self.words or self.cuts:
            return self._joined(self._parts(texts))
        own = [np.append(self._ids(t), np.array([self.end_id], self.kind)) for t in texts.to_pylist()]
        return np.concatenate(own), np.cumsum([len(x) for x in own])

    def _parts(self, texts: pa.Array) -> pa.Array:
        """Lists of the parts of texts."""
        if self.words:
            apart = pc.replace_substring_regex(pc.replace_substring(texts, "\n", " "), rf"([{_LETTERS}])([.,;:!?#*$%&|<>])", r"\1 \2")
            special = pc.match_substring(texts, "<|")  # the name of a special token may be in it
            return pc.split_pattern(pc.if_else(special, pc.replace_substring(texts, "\n", " "), apart), " ")
        fast = pc.replace_substring(pc.replace_substring(texts, "\n", "\x01\n\x01"), " ", "\x01 ")
        cuts = pc.split_pattern(pc.replace_substring_regex(fast, rf"([{_LETTERS}])([.,;:!?#*$%&|<>])", "\\1\x01\\2"), "\x01")
        slow = pc.or_(pc.match_substring_regex(texts, _SLOW), pc.match_substring_regex(texts, _RARE)).to_numpy(zero_copy_only=False)
        if slow.any():
            own = [[c if i == 0 else f" {c}" for i, c in enumerate(_SINGLE_BLANK.split(t))] for t in texts.filter(pa.array(slow)).to_pylist()]
            both = pa.concat_arrays([cuts, pa.array(own, cuts.type)])
            cuts = both.take(pa.array(np.where(slow, np.cumsum(slow) - 1 + len(texts), np.arange(len(texts)))))
        return cuts

    def _joined(self, cuts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that are lists of parts, by the cache."""
        sizes = pc.list_value_length(cuts).to_numpy(zero_copy_only=False)
        coded = pc.dictionary_encode(cuts.flatten())
        del cuts  # what is not needed any more goes at once: a slice takes many times its text
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        del coded
        self._learn(words)
        # a table of byte strings, the parts and then the end id; and each text's rows of it in order
        table = [*map(self.parts.__getitem__, words), np.array([self.end_id], self.kind).tobytes()]
        rows = np.insert(codes, np.cumsum(sizes), len(words))
        del words, codes
        long = np.fromiter(map(len, table), np.int64, len(table)) // self.kind.itemsize
        begin = np.cumsum(long) - long
        flat, n = np.frombuffer(b"".join(table), self.kind), long[rows]
        del table
        upto = np.cumsum(n)
        ends = upto[np.cumsum(sizes + 1) - 1]
        first = begin[rows]
        first -= upto
        first += n
        del rows, upto
        at = np.repeat(first, n)
        del first, n
        at += np.arange(len(at))
        return flat[at], ends


def encoder(path: str, end_id: int = 0) -> Encoder:
    """This worker's encoder; it outlives a task where Spark uses a worker again for such tasks."""
    return kept(("encoder", path, end_id), lambda: Encoder(path, end_id))
