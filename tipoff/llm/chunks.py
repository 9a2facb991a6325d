"""Tokenizer libraries run over whole texts by the chunk: each distinct chunk goes to the library once in a while.

A text is cut where no token of the tokenizer can reach across, so that the ids of the text are the ids of its chunks in
order. Ids of chunks are kept in two generations of a dictionary: frequent chunks stay, rare ones are forgotten, and
memory is bounded by ``KEPT`` chunks a generation of at most ``LONGEST`` characters.

A word tokenizer gets whole columns: Arrow cuts the texts and finds the distinct chunks, Python sees each of these once, and the new
words of a column's Latin chunks go to the library's model in one call.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from tipoff.llm.bpe import WHITE, byte_letters

KEPT = 500_000
LONGEST = 200
PIECE = 1 << 16  # chunks whose ids are put together at once
# the split of word tokenizers that drop white space; fixed by the tokenizer file
WORDS_ONLY = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# both splits for text below U+0250: letters and digits there are the same in every version of Unicode, and nothing composes
LATIN = "\u0250"
LATIN_BYTES = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
).findall
LETTERS = dict(enumerate(byte_letters()))
JOINED = {b: c for b, c in LETTERS.items() if b != 32}  # of words with a blank between each two
CUT = b"\xff\xff\xff\xff"  # no id
PRINTABLE = re.compile("[ -~]*").fullmatch  # bytes that stand for themselves, and blanks
BEYOND_LATIN = re.compile(f"[^\x00-{chr(ord(LATIN) - 1)}]").search


def letters(word: str) -> str:
    """A word's bytes as the byte-level letters the model knows."""
    return (word if word.isascii() else word.encode().decode("latin-1")).translate(LETTERS)


def packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class Known(dict):
    """Ids by chunk: what is not there comes from the generation before, else from the library."""

    def __init__(self, ids_of: Callable[[str], bytes], before: dict):
        super().__init__()
        self.ids_of, self.before = ids_of, before

    def __missing__(self, chunk: str) -> bytes:
        found = self.before.get(chunk)
        if found is None:
            found = self.ids_of(chunk)
        if len(chunk) <= LONGEST:
            self[chunk] = found
        return found


class Chunked:
    """Base: ``cut`` gives the chunks of a text, ``ids_of`` the ids of one chunk from the library."""

    def __init__(self) -> None:
        self.kept = KEPT
        self.known = Known(self.ids_of, {})
        self.words: dict[str, bytes] = {}

    def cut(self, text: str) -> list[str]:
        raise NotImplementedError

    def ids_of(self, chunk: str) -> bytes:
        raise NotImplementedError

    def ids_of_words(self, words: list[str]) -> bytes:
        """Ids of the model's words, which repeat in chunks that differ by a comma."""
        ids = []
        for word in words:
            found = self.words.get(word)
            if found is None:
                found = packed([t.id for t in self.merge(letters(word))])
                if len(word) <= LONGEST:
                    self.words[word] = found
            ids.append(found)
        if len(self.words) > self.kept:
            self.words.clear()
        return b"".join(ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        out = []
        for text in texts:
            out.append(b"".join(map(self.known.__getitem__, self.cut(text))))
            if len(self.known) > self.kept:
                self.known.before = {}
                self.known = Known(self.ids_of, self.known)
        return out


def _library(path: str, special_is_text: bool):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the machine already
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    t.encode_special_tokens = special_is_text
    return t


def _latin_words() -> Callable[[str], list[str]]:
    """The split ``WORDS_ONLY`` for Latin text in lower case, its classes written out and each blank a match of its own."""
    kinds = {c: unicodedata.category(c)[0] for c in map(chr, range(ord(LATIN)))}
    letter, number = ("".join(re.escape(c) for c in kinds if kinds[c] == k) for k in "LN")
    white = "".join(c for c in kinds if regex.match(f"[{WHITE}]", c))
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]| |[^{white}{letter}{number}]+").findall


class Words(Chunked):
    """A tokenizer file that drops white space; any other file of the library is run over whole texts.

    The words of Latin chunks without special tokens go to the library's model, other chunks to the library as they are.
    """

    def __init__(self, path: str):
        super().__init__()
        self.library = _library(path, False)
        self.merge = self.library.model.tokenize
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.size = 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        self.by_word = splits.get("pattern", {}).get("Regex") == WORDS_ONLY and splits.get("behavior") == "Removed"
        self.marks = {t["content"][0] for t in spec["added_tokens"]}
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        if self.by_word:
            from tokenizers import Tokenizer, pre_tokenizers

            self.latin_words = _latin_words()
            # the same model, for words that are cut and lettered already
            self.joined = Tokenizer(self.library.model)
            self.joined.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
            # the tokens that end a word, one a word; none if the model marks no ends
            suffix = spec["model"].get("end_of_word_suffix")
            self.ends = np.zeros(self.size, bool)
            self.ends[[i for t, i in spec["model"]["vocab"].items() if suffix and t.endswith(suffix)]] = True

    def ids_of(self, chunk):
        return packed(self.library.encode(chunk, add_special_tokens=False).ids)

    def learn_words(self, words: list[str]) -> None:
        """Ids of new words, all in one call of the library's model."""
        form = " ".join(words)
        if not PRINTABLE(form):
            form = form.encode().decode("latin-1").translate(JOINED)
        ids = np.array(self.joined.encode_batch_fast([form], add_special_tokens=False)[0].ids, "<u4")
        stops = 4 * (np.flatnonzero(self.ends[ids]) + 1)
        if len(stops) != len(words) or stops[-1] != 4 * len(ids):  # the model lacks a letter, or does not mark ends
            self.words.update((word, packed([t.id for t in self.merge(letters(word))])) for word in words)
            return
        flat, stops = ids.tobytes(), stops.tolist()
        self.words.update(zip(words, [flat[a:b] for a, b in zip([0, *stops], stops)]))

    def is_latin(self, chunks: str) -> bool:
        return (chunks.isascii() or not BEYOND_LATIN(chunks)) and not any(mark in chunks for mark in self.marks)

    def learn(self, chunks: list[str]) -> None:
        """Ids of new chunks."""
        latin = [] if not self.by_word else chunks if self.is_latin(" ".join(chunks)) else [c for c in chunks if self.is_latin(c)]
        if latin:
            found = self.latin_words(" ".join(latin).lower())
            self.words.pop(" ", None)
            new = set(found).difference(self.words)
            new.discard(" ")
            plain = set(filter(str.isascii, new))
            for words in (plain, new - plain):
                if words:
                    self.learn_words(list(words))
            self.words[" "] = CUT
            flat = b"".join(map(self.words.__getitem__, found))
            stops = (4 * np.flatnonzero(np.frombuffer(flat, "<u4") == 0xFFFFFFFF)).tolist()
            self.known.update(zip(latin, [flat[a:b] for a, b in zip([0, *[x + 4 for x in stops]], [*stops, len(flat)])]))
            if max(map(len, new), default=0) > LONGEST:
                self.words = {word: ids for word, ids in self.words.items() if len(word) <= LONGEST}
            if len(self.words) > self.kept:
                self.words.clear()
        if len(latin) < len(chunks):
            self.known.update((c, self.ids_of(c)) for c in chunks if c not in self.known)

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column, nulls being empty, as unsigned 32-bit integers, and where each text's begin and end."""
        column = column.cast(pa.large_string()).fill_null("")
        if self.by_word:
            rows = pc.ascii_split_whitespace(column)
            offsets, flat = rows.offsets.to_numpy(), rows.flatten()
            offsets = offsets - offsets[0]
        else:
            offsets, flat = np.arange(len(column) + 1), column
        distinct = flat.dictionary_encode()
        at, chunks = distinct.indices.to_numpy(), distinct.dictionary.to_numpy(zero_copy_only=False).tolist()
        each = list(map(self.known.get, chunks))
        new = [c for c, ids in zip(chunks, each) if ids is None]
        if new:
            if self.before:
                self.known.update((c, self.before[c]) for c in new if c in self.before)
            self.learn([c for c in new if c not in self.before])
            each = [self.known[c] if ids is None else ids for c, ids in zip(chunks, each)]
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
        starts, ids = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(each), "<u4")
        out = [np.zeros(0, "<u4")]
        for a in range(0, len(at), PIECE):
            part = at[a : a + PIECE]
            n = sizes[part]
            ends = np.cumsum(n)
            out.append(ids[np.arange(ends[-1]) + np.repeat(starts[part] - ends + n, n)])
        for c in new:
            if len(c) > LONGEST:
                del self.known[c]
        if len(self.known) > self.kept:
            self.before, self.known = self.known, {}
        return np.concatenate(out), np.concatenate([[0], np.cumsum(sizes[at])])[offsets]

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, offsets = self.encode_column(pa.array(texts, pa.large_string()))
        return [ids[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


class Bytes(Chunked):
    """A byte-level tokenizer file, special tokens being plain text: a blank goes with what follows it.

    ``cut`` merges the library's own pieces up to the next white space; runs of white space are cut as it cuts them.
    """

    def __init__(self, path: str):
        super().__init__()
        self.library = _library(path, True)
        self.merge = self.library.model.tokenize
        self.cut = regex.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+").findall

    def ids_of(self, chunk):
        if max(chunk) < LATIN:
            return self.ids_of_words(LATIN_BYTES(chunk))
        return packed(self.library.encode(chunk, add_special_tokens=False).ids)


class Pieces(Chunked):
    """A sentencepiece model no piece of which has a blank after another character: texts are cut before runs of blanks.

    The library puts a blank before each text, so a chunk goes without its first one.
    """

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.blank = [self.library.piece_to_id("▁")]
        self.by_blank = not any("▁" in name.lstrip("▁") for name in names)
        self.runs = regex.compile("[ ▁]*[^ ▁]+|[ ▁]+").findall  # the library writes a blank as U+2581

    def cut(self, text: str) -> list[str]:
        if not text:
            return []
        if not self.by_blank:
            return [text]
        if "  " in text or "▁" in text or text[0] == " " or text[-1] == " ":
            return [c[1:] for c in self.runs(" " + text)]
        return text.split(" ")

    def ids_of(self, chunk):
        return packed(self.library.encode(chunk) if chunk else self.blank)  # an empty chunk is one blank at the end


_KEPT: dict[tuple[type, str], Chunked] = {}


def chunked(kind: type, path: str) -> Chunked:
    """The tokenizer of a file, read once in a process."""
    if (kind, path) not in _KEPT:
        _KEPT[kind, path] = kind(path)
    return _KEPT[kind, path]
