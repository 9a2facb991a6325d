"""Two tokenizers' tokens of the same text brought into line by divide and conquer at shared cuts.

Tokens of A (a byte-level tokenizer file) and of B (a sentencepiece model) are byte ranges of a blank and the text. In an
interval of tokens that covers the same bytes on both sides, the A end nearest the middle is found by bisection and looked
up among B's ends by bisection; if it is not shared, the next ends outwards are tried, twice as many each time. A shared
end cuts the interval in two halves, which are treated alike; an interval without one is a leaf, a group. All intervals of
a batch of documents take a step at once, so a batch needs about as many steps as its longest document halves.

Two tokens are linked if their bytes overlap. Corpus counts of linked id pairs travel by batch, not by document: each
batch (about ``BATCH_BYTES`` of text, a longer document alone) asks once for each of its pairs, and the answers come back to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.llm.bpe import byte_letters
from tipoff.llm.chunks import Bytes, Pieces, chunked
from tipoff.llm.common import row_batches, texts
from tipoff.scratch import stage

BATCH_BYTES = 2 << 20


class Names:
    """What a token of each tokenizer stands for in bytes, and how groups are written."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = chunked(Bytes, path_a), chunked(Pieces, path_b)
        self.a.kept = self.b.kept = 300_000  # two tokenizers share a task's memory
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        vocabulary = self.a.library.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (1 + max(vocabulary.values()))
        for name, i in vocabulary.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in name) if all(c in byte_of for c in name) else name.encode()
        b = self.b.library
        self.bytes_b = [
            bytes([int(name[3:5], 16)]) if b.is_byte(i) else name.replace("▁", " ").encode()
            for i, name in enumerate(map(b.id_to_piece, range(b.get_piece_size())))
        ]
        self.len_a, self.len_b = (np.array(list(map(len, t)), np.int64) for t in (self.bytes_a, self.bytes_b))
        # no normaliser and a token for every byte: nothing can get lost
        self.lossless_a = self.a.library.normalizer is None and byte_of.keys() <= vocabulary.keys()
        # the normaliser leaves every character as it is and every byte has a token: only U+2581, read as a blank, changes a text, and its length
        every = "".join(chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and chr(c) not in " ▁")
        self.lossless_b = b.normalize(every) == "▁" + every and all(b.is_byte(b.piece_to_id(f"<0x{n:02X}>")) for n in range(256))
        self.bits_b = len(self.bytes_b).bit_length()
        self.bits = self.bits_b + len(self.bytes_a).bit_length()
        ends = [(self.bytes_a, ",|"), (self.bytes_b, ",;")]
        self.written = [f"{i}{end}" for table, both in ends for i in range(len(table)) for end in both]


_NAMES: dict[tuple[str, str], Names] = {}


def names_of(path_a: str, path_b: str) -> Names:
    """Both tokenizers, read once in a process."""
    if (path_a, path_b) not in _NAMES:
        _NAMES[path_a, path_b] = Names(path_a, path_b)
    return _NAMES[path_a, path_b]


def _near_middle(a_end, b_end, a_lo, a_hi):
    """For each interval the A token that ends nearest the middle at an end of B too, and that B token; -1 where there is none."""
    start = np.where(a_lo > 0, a_end[a_lo - 1], 0)
    middle = np.clip(np.searchsorted(a_end, (start + a_end[a_hi - 1]) // 2), a_lo, a_hi - 2)
    at_a, at_b = np.full(len(a_lo), -1), np.full(len(a_lo), -1)
    open_, near, steps = np.arange(len(a_lo)), 0, np.zeros(1, np.int64)
    while len(open_):
        mid, lo, hi = middle[open_], a_lo[open_], a_hi[open_] - 2
        tried = mid[:, None] + steps
        inside = (tried >= lo[:, None]) & (tried <= hi[:, None])
        ends = a_end[np.where(inside, tried, mid[:, None])]
        place = np.searchsorted(b_end, ends)
        shared = inside & (b_end[place] == ends)
        first = shared.argmax(1)
        rows = np.arange(len(open_))
        got = shared[rows, first]
        at_a[open_[got]] = tried[rows[got], first[got]]
        at_b[open_[got]] = place[rows[got], first[got]]
        near += len(steps) // 2 if near else 1
        far = np.arange(near, 2 * near)
        steps = np.stack([far, -far], 1).ravel()
        open_ = open_[~got & (np.maximum(mid - lo, hi - mid) >= near)]
    return at_a, at_b


def shared_cuts(a_end: np.ndarray, b_end: np.ndarray, a_ptr: np.ndarray, b_ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The leaf groups of all documents in order, each by the token after its last one, for A and for B.

    ``a_end``, ``b_end`` are the tokens' byte ends, running on over documents; ``a_ptr``, ``b_ptr`` where documents' tokens begin.
    """
    todo = np.stack([a_ptr[:-1], a_ptr[1:], b_ptr[:-1], b_ptr[1:]])
    todo = todo[:, todo[0] < todo[1]]
    leaves = []
    while todo.shape[1]:
        alone = (todo[1] - todo[0] == 1) | (todo[3] - todo[2] == 1)
        leaves.append(todo[:, alone])
        todo = todo[:, ~alone]
        at_a, at_b = _near_middle(a_end, b_end, todo[0], todo[1])
        leaves.append(todo[:, at_a < 0])
        cut = at_a >= 0
        todo, at_a, at_b = todo[:, cut], at_a[cut] + 1, at_b[cut] + 1
        halves = np.stack([todo[0], at_a, todo[2], at_b]), np.stack([at_a, todo[1], at_b, todo[3]])
        todo = np.stack(halves, axis=2).reshape(4, -1)  # in text order, so that bisections go through memory in order
    done = np.concatenate(leaves, axis=1) if leaves else np.zeros((4, 0), np.int64)
    done = done[:, np.argsort(done[0], kind="stable")]
    return done[1], done[3]


def _ids(encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(encoded), "<u4").astype(np.int64), np.cumsum([0, *(len(e) // 4 for e in encoded)])


def _planes(numbers: np.ndarray) -> bytes:
    """Small numbers with their low bytes together and their (mostly zero) high bytes together, for the file's compression."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


class Aligned:
    """Groups and links of the texts of one batch; texts that a tokenizer does not give back byte by byte have no tokens."""

    def __init__(self, batch: list[str], names: Names):
        whole = [" " + t if t else "" for t in batch]
        a, b = names.a.encode(whole), names.b.encode(batch)
        for i, text in enumerate(whole):
            data = text.encode("utf-8", "surrogatepass")
            ids_a, ids_b = np.frombuffer(a[i], "<u4"), np.frombuffer(b[i], "<u4")
            for ids, table, sizes, lossless in ((ids_a, names.bytes_a, names.len_a, names.lossless_a), (ids_b, names.bytes_b, names.len_b, names.lossless_b)):
                if not (sizes[ids].sum() == len(data) if lossless else b"".join(map(table.__getitem__, ids.tolist())) == data):
                    a[i] = b[i] = b""
        self.names = names
        (self.a, self.a_ptr), (self.b, self.b_ptr) = _ids(a), _ids(b)
        self.a_end, self.b_end = np.cumsum(names.len_a[self.a]), np.cumsum(names.len_b[self.b])
        self.a_stop, self.b_stop = shared_cuts(self.a_end, self.b_end, self.a_ptr, self.b_ptr)
        self.group_ptr = np.searchsorted(self.a_stop, self.a_ptr, side="right")

    def groups(self) -> Iterator[str]:
        """Each text's groups as ``a1,a2|b1;a3|b2,b3``; '' without tokens."""
        n_a, n_b = np.diff(self.a_stop, prepend=0), np.diff(self.b_stop, prepend=0)
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        last_a, last_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        last_a[self.a_stop - 1] = last_b[self.b_stop - 1] = 1
        codes[np.arange(len(self.a)) + np.repeat(self.b_stop - n_b, n_a)] = 2 * self.a + last_a
        codes[np.arange(len(self.b)) + np.repeat(self.a_stop, n_b)] = 2 * len(self.names.bytes_a) + 2 * self.b + last_b
        ptr, written = self.a_ptr + self.b_ptr, self.names.written
        for lo, hi in zip(ptr[:-1].tolist(), ptr[1:].tolist()):
            yield "".join(map(written.__getitem__, codes[lo:hi].tolist()))[:-1]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """The id pair of every link, text by text, and where texts begin: between two neighbouring ends of either side lie one
        token of A and one of B, and each such pair of tokens meets once."""
        size = int(self.a_end[-1]) + 1 if len(self.a_end) else 1
        is_a, is_b = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
        is_a[self.a_end] = is_b[self.b_end] = 1
        ends = np.flatnonzero(is_a | is_b)
        # the token that reaches an end is the one after all that end before
        before_a, before_b = (np.cumsum(x[ends], dtype=np.int64) - x[ends] for x in (is_a, is_b))
        pairs = self.a[before_a] << self.names.bits_b | self.b[before_b]
        return pairs, self.a_ptr + self.b_ptr - self.group_ptr


_KINDS = {
    "doc_ids": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(),
    "groups_sha256": pa.string(), "groups": pa.string(),
}
_DOCS = [name for name in _KINDS if name != "doc_ids"]
_BATCH = (
    "batch bigint, " + ", ".join(f"{n} array<{'string' if k == pa.string() else 'bigint'}>" for n, k in _KINDS.items())
    + ", place binary, times binary, ptr binary, pairs binary, counts binary"
)


def _aligned_batches(docs: DataFrame, path_a: str, path_b: str, with_groups: bool) -> DataFrame:
    """One row a batch: its documents' numbers, each document's distinct pairs as places in the batch's sorted pairs, and those."""

    def run(batches):
        names, batch_id = names_of(path_a, path_b), TaskContext.get().partitionId() << 32
        for batch in row_batches(batches, BATCH_BYTES):
            done = Aligned(texts(batch.column(1)), names)
            pairs, link_ptr = done.links()
            owner = np.repeat(np.arange(batch.num_rows), np.diff(link_ptr))
            both, times = np.unique(owner << names.bits | pairs, return_counts=True)
            mine = both & (1 << names.bits) - 1
            known = np.unique(mine)
            place = np.searchsorted(known, mine)
            counts = np.bincount(place, times, minlength=len(known)).astype(np.int64)
            ptr = np.searchsorted(both >> names.bits, np.arange(batch.num_rows + 1))
            steps = np.diff(place, prepend=0)
            inner = ptr[:-1][np.diff(ptr) > 0]
            steps[inner] = place[inner]
            columns = {
                "doc_ids": batch.column(0), "n_a": np.diff(done.a_ptr), "n_b": np.diff(done.b_ptr),
                "n_groups": np.diff(done.group_ptr), "n_links": np.diff(link_ptr), "groups_sha256": [], "groups": [],
            }
            for text in done.groups():
                columns["groups_sha256"].append(hashlib.sha256(text.encode()).hexdigest() if text else "")
                columns["groups"].append(text if with_groups else None)
            lists = [
                pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), pa.array(columns[n], k)) for n, k in _KINDS.items()
            ]
            blobs = [_planes(steps), _planes(times), _planes(ptr), known.tobytes(), counts.tobytes()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch_id]), *lists, *(pa.array([x], pa.binary()) for x in blobs)],
                ["batch", *_KINDS, "place", "times", "ptr", "pairs", "counts"],
            )
            batch_id += 1

    return docs.select("doc_id", "text").mapInArrow(run, _BATCH)


def _asked(batches):
    """(pair, batch, n): the links of each of a batch's pairs."""
    for batch in batches:
        for batch_id, pairs, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            pairs, counts = np.frombuffer(pairs.as_buffer(), np.int64), np.frombuffer(counts.as_buffer(), np.int64)
            for a in range(0, len(pairs), 1 << 16):
                part = pairs[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part), pa.array(np.full(len(part), batch_id)), pa.array(counts[a : a + (1 << 16)])], ["pair", "batch", "n"]
                )


def _answered(batch: pa.Table, answers: pa.Table) -> pa.Table:
    """One batch's documents with the sums over their links of what the corpus says of the pairs."""
    row = {name: batch.column(name)[0] for name in batch.column_names}
    order = np.argsort(answers.column("pair").to_numpy())
    count, best = (answers.column(n).to_numpy()[order] for n in ("count", "best"))
    ptr, times, place = (_from_planes(row[n].as_py()) for n in ("ptr", "times", "place"))
    first = np.zeros(len(place), bool)
    first[ptr[:-1][np.diff(ptr) > 0]] = True
    total = np.cumsum(place)
    begin = np.flatnonzero(first)
    if len(place):
        place = total - np.repeat(total[begin] - place[begin], np.diff(np.r_[begin, len(place)]))
    sums = [np.r_[0, np.cumsum(times * of[place])] for of in (best.astype(np.int64), count)]
    n_best, count_sum = (s[ptr[1:]] - s[ptr[:-1]] for s in sums)
    columns = {"doc_id": row["doc_ids"].values, **{n: row[n].values for n in _DOCS}, "n_best": pa.array(n_best), "count_sum": pa.array(count_sum)}
    return pa.table(columns)


def align(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_a and n_b tokens, n_groups, n_links, n_best (links whose pair has the highest count of
    all pairs with that B id), count_sum (of the links' pair counts), groups_sha256 and, if asked for, groups (else null).

    Texts that are null, empty or not given back byte by byte have no tokens: zeros and ''. Equal rows stay and count each.
    Other columns are left out. Counts cover all rows; none is collected.
    """
    batches = stage(_aligned_batches(docs, path_a, path_b, with_groups), "aligned")
    asked = batches.select("batch", "pairs", "counts").mapInArrow(_asked, "pair bigint, batch bigint, n bigint")
    bits_b = names_of(path_a, path_b).bits_b
    counts = stage(asked.groupBy("pair").agg(F.sum("n").alias("count")), "pairs").withColumn("b", F.col("pair").bitwiseAND((1 << bits_b) - 1))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    known = counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    answers = asked.select("pair", "batch").join(known, "pair").select("batch", "pair", "count", "best")
    kinds = ", ".join(["doc_id bigint", *(f"{n} {'string' if _KINDS[n] == pa.string() else 'bigint'}" for n in _DOCS), "n_best bigint", "count_sum bigint"])
    done = batches.select("batch", *_KINDS, "place", "times", "ptr").groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_answered, kinds)
    return done.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups")
