"""BPE encoding and decoding by speculation and verification.

A word is first cut greedily into the longest tokens of the vocabulary. That guess is right exactly if every two
neighbouring tokens are compatible, that is, if merging the two together by the merge rules gives the same two
tokens again. Compatibility of all pairs of a batch's new words is looked up at once in a sorted table that
grows as pairs come up; only words with an incompatible pair are merged exactly, by a heap over their symbols.

The rules (normalisation, splitting, vocabulary, merges, special tokens) are read from a tokenizer file of the
``tokenizers`` format whose model is BPE with an end-of-word suffix, at a path given as a parameter.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from tipoff.llm.common import texts

END = "\ue000"  # stands for the end-of-word suffix within this module
WORDS_KEPT = 400_000
# what the tokenizer format calls white space in a pattern's \s
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the rest from U+0100 on, in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def _runs(letters: list[str]) -> list[list[str]]:
    """Sorted characters as runs of neighbours."""
    out: list[list[str]] = []
    for c in letters:
        if out and ord(out[-1][-1]) + 1 == ord(c):
            out[-1].append(c)
        else:
            out.append([c])
    return out


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        own = lambda t: t[: -len(suffix)] + END if t.endswith(suffix) else t
        self.ids = {own(t): i for t, i in model["vocab"].items()}
        self.tokens = {i: t for t, i in self.ids.items()}
        self.pieces = {i: t for t, i in model["vocab"].items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {}
        for k, (a, b) in enumerate(merges):
            pair = own(a), own(b)
            if pair[0] in self.ids and pair[1] in self.ids and pair[0] + pair[1] in self.ids:
                self.ranks[pair] = k
        self.longest = max(map(len, self.ids))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces |= {i: t for t, i in self.special.items()}
        self.cut_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")")
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        split = split.replace(r"[^\s", "[^" + WHITE)
        self.words_in = regex.compile(split).findall
        # letters and digits that Unicode got after the format's tables count as other characters
        late = regex.findall(r"[\p{L}\p{N}]", "".join(c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) == "Cn"))
        spans = "".join(f"{run[0]}-{run[-1]}" for run in _runs(late)) or END
        self.late, self.first_late = frozenset(late), ord(min(late, default="\U0010ffff"))
        self.words_in_late = regex.compile(
            f"'s|'t|'re|'ve|'m|'ll|'d|(?:(?![{spans}])\\p{{L}})+|(?![{spans}])\\p{{N}}|(?:[{spans}]|[^{WHITE}\\p{{L}}\\p{{N}}])+"
        ).findall
        self.white = regex.compile(f"[{WHITE}]+")
        self.letters = dict(enumerate(byte_letters()))
        self.cache: dict[str, bytes] = {}
        self.pair_keys = np.zeros(0, np.int64)
        self.pair_fit = np.zeros(0, bool)

    # -- words

    def symbols(self, word: str) -> str:
        """A word's bytes as letters, with the end mark."""
        return word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters) + END

    def speculate(self, s: str) -> list[int] | None:
        """Longest tokens from the left; None where no token fits. The last letter and the end mark stay together."""
        out, at, n, ids, longest = [], 0, len(s), self.ids, self.longest
        while at < n:
            for stop in range(min(n, at + longest), at, -1):
                if stop == n - 1:
                    continue
                found = ids.get(s[at:stop])
                if found is not None:
                    out.append(found)
                    at = stop
                    break
            else:
                return None
        return out

    def atoms(self, s: str) -> list[str]:
        """The symbols merging starts from: single letters, the last one of a word with its end mark."""
        return [*s[:-2], s[-2:]] if s[-1] == END else [*s]

    def merge(self, s: str) -> list[int]:
        """Exact merging: the best-ranked adjacent pair first, the leftmost of equal ones, by a heap."""
        parts: list[str | None] = self.atoms(s)
        n = len(parts)
        after, before, ranks = list(range(1, n + 1)), list(range(-1, n - 1)), self.ranks
        heap = [(ranks[p], i, *p) for i in range(n - 1) if (p := (parts[i], parts[i + 1])) in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (p := (a + b, parts[k])) in ranks:
                    heapq.heappush(heap, (ranks[p], i, *p))
            h = before[i]
            if h >= 0 and (p := (parts[h], a + b)) in ranks:
                heapq.heappush(heap, (ranks[p], h, *p))
        return [self.ids[p] for p in parts if p is not None]

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each pair of neighbouring tokens, whether merging them alone leaves them as they are."""
        keys = left.astype(np.int64) << 32 | right
        new = np.setdiff1d(keys, self.pair_keys)
        if len(new):
            if len(self.pair_keys) > 4_000_000:
                self.pair_keys, self.pair_fit = np.zeros(0, np.int64), np.zeros(0, bool)
                new = np.unique(keys)
            names = self.tokens
            fit = [self.merge(names[a] + names[b]) == [a, b] for a, b in zip((new >> 32).tolist(), (new & 0xFFFFFFFF).tolist())]
            order = np.argsort(np.r_[self.pair_keys, new], kind="stable")
            self.pair_fit = np.r_[self.pair_fit, np.array(fit, bool)][order]
            self.pair_keys = np.r_[self.pair_keys, new][order]
        return self.pair_fit[np.searchsorted(self.pair_keys, keys)]

    def encode_words(self, words: list[str]) -> None:
        """Puts the ids of new words into the cache, as little-endian unsigned 32-bit integers."""
        forms = [self.symbols(w) for w in words]
        guesses = [self.speculate(s) for s in forms]
        sizes = np.array([0 if g is None else len(g) for g in guesses])
        flat = np.fromiter((t for g in guesses if g for t in g), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        bad = np.zeros(len(words), bool)
        bad[owner[inner[~self.compatible(flat[inner], flat[inner + 1])]]] = True
        bad[sizes == 0] = True
        for word, form, guess, wrong in zip(words, forms, guesses, bad.tolist()):
            self.cache[word] = np.array(self.merge(form) if wrong else guess, "<u4").tobytes()

    # -- texts

    def normalise(self, text: str) -> str:
        if not text.isascii():
            # each character alone: no special form of a final sigma
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def split(self, text: str) -> list[str]:
        late = not text.isascii() and np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).max() >= self.first_late and not self.late.isdisjoint(text)
        return (self.words_in_late if late else self.words_in)(text)

    def encode(self, batch: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        parts: list[list[list[str] | bytes]] = []
        for text in batch:
            pieces = self.cut_special.split(text) if self.special else [text]
            parts.append(
                [np.array([self.special[p]], "<u4").tobytes() if k % 2 else self.split(self.normalise(p)) for k, p in enumerate(pieces)]
            )
        if len(self.cache) > WORDS_KEPT:
            self.cache.clear()
        cache = self.cache
        new = {w for doc in parts for p in doc if not isinstance(p, bytes) for w in p if w not in cache}
        if new:
            self.encode_words(sorted(new))
        return [b"".join(p if isinstance(p, bytes) else b"".join([cache[w] for w in p]) for p in doc) for doc in parts]

    def decode(self, ids: bytes) -> str:
        """Tokens joined by blanks, special ones included, as the format does where it names no decoder."""
        pieces = self.pieces
        return " ".join([pieces[i] for i in np.frombuffer(ids, "<u4").tolist()])


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a file, read once in a process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _slices(column: list[str], chars: int = 4 << 20):
    start, total = 0, 0
    for i, t in enumerate(column):
        total += len(t)
        if total >= chars:
            yield column[start : i + 1]
            start, total = i + 1, 0
    if start < len(column):
        yield column[start:]


def encode(text: Column, path: str) -> Column:
    """Token ids of a text as array<bigint>; a null text has none, as an empty one."""

    @F.arrow_udf("array<long>")
    def run(column: pa.Array) -> pa.Array:
        out = [np.frombuffer(b, "<u4").astype(np.int64) for part in _slices(texts(column)) for b in codec(path).encode(part)]
        return pa.array(out, pa.list_(pa.int64()))

    return run(text)


def decode(ids: Column, path: str) -> Column:
    """The text of token ids; null has the empty one."""

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([codec(path).decode(np.array(x or [], "<u4").tobytes()) for x in column.to_pylist()], pa.string())

    return run(ids)


def round_trip(text: Column, path: str) -> Column:
    """Struct of n_tokens, ids (binary: little-endian unsigned 32-bit integers), ids_sha256 (of those bytes) and decoded_sha256
    (of the decoded text in UTF-8) of a text; null counts as empty. The decoded text does not leave the task."""

    @F.arrow_udf("struct<n_tokens: bigint, ids: binary, ids_sha256: string, decoded_sha256: string>")
    def run(column: pa.Array) -> pa.Array:
        n, packed_ids, first, second = [], [], [], []
        for part in _slices(texts(column)):
            for ids in codec(path).encode(part):
                n.append(len(ids) // 4)
                packed_ids.append(ids)
                first.append(hashlib.sha256(ids).hexdigest())
                second.append(hashlib.sha256(codec(path).decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(packed_ids, pa.binary()), pa.array(first, pa.string()), pa.array(second, pa.string())],
            names=["n_tokens", "ids", "ids_sha256", "decoded_sha256"],
        )

    return run(text)
