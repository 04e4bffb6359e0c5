"""Edit-aware token counts: a segment tree of pre-token runs for each document, updated where edits touch it.

`build` cuts a text into pre-tokens, puts LEAF of them in a leaf, and keeps each leaf's code points and tokens. `recount`
makes a tree of sums of them, finds the leaf of an edit by descending the tree, and encodes again from one leaf before the
edit (the pattern looks one character ahead, so at most two pre-tokens before an edit can change) to the first old leaf
boundary after it at which a new pre-token ends; from there on the old leaves hold. Only their sums on the way to the root
change.

Edits are structs (start, end, text) in code points of the original text, sorted, not overlapping; edits whose re-encoded
regions meet are done in one go, as the later starts from the tree that the earlier left.

Cases: a null or empty text counts 0 tokens and has no leaves; null edits are none. Edits out of order or outside the text
are an error. Very long pre-tokens are a leaf's part like any other. Repeated rows give repeated rows; other columns pass
through `build` unchanged, but clash with n_tokens, n_chars, leaf_chars and leaf_tokens, which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept

#: Pre-tokens of a leaf.
LEAF = 32
#: Pre-tokens whose counts a Python worker keeps.
CACHE = 600_000


class Counts(dict):
    """Pre-token to its number of tokens; unknown ones are encoded when asked for."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        from .bpe import vocabulary

        super().__init__()
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=dict(vocabulary(path)), special_tokens={}).encode_ordinary
        self.find = regex.compile(pattern).findall
        self.iter = regex.compile(pattern).finditer

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        n = self[word] = len(self.encode(word))
        return n


def counts_of(path: str, pattern: str) -> Counts:
    return kept(("counts", path, pattern), lambda: Counts(path, pattern))


def leaves(text: str, counts: Counts) -> tuple[np.ndarray, np.ndarray]:
    """Code points and tokens of each leaf."""
    words = counts.find(text)
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    n = len(words)
    cuts = np.arange(0, n, LEAF)
    chars = np.add.reduceat(np.fromiter(map(len, words), np.int32, n), cuts)
    tokens = np.add.reduceat(np.fromiter(map(counts.__getitem__, words), np.int32, n), cuts)
    return chars, tokens


class SumTree:
    """A binary tree over leaves: sums of code points and of tokens."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.m = 1 << max(0, int(len(chars) - 1).bit_length()) if len(chars) else 1
        self.levels = []
        for x in (chars, tokens):
            level = np.zeros(self.m, np.int64)
            level[: len(x)] = x
            tree = [level]
            while len(level) > 1:
                level = level[0::2] + level[1::2]
                tree.append(level)
            self.levels.append(tree)

    def set(self, leaf: int, chars: int, tokens: int) -> None:
        for tree, value in zip(self.levels, (chars, tokens)):
            change = value - int(tree[0][leaf])
            for depth, level in enumerate(tree):
                level[leaf >> depth] += change

    def total(self) -> int:
        return int(self.levels[1][-1][0])

    def at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a code point (or the last leaf with any), and where it starts."""
        tree, node, start = self.levels[0], 0, 0
        place = min(place, int(tree[-1][0]) - 1)
        for level in reversed(tree[:-1]):
            node *= 2
            if place - start >= level[node]:
                start += int(level[node])
                node += 1
        return node, start

    def chars(self, leaf: int) -> int:
        return int(self.levels[0][0][leaf])


def apply(text: str, chars: np.ndarray, tokens: np.ndarray, edits: list[tuple[int, int, str]], counts: Counts) -> tuple[int, int]:
    """(tokens of the edited text, code points encoded again)."""
    if not len(chars):
        new = "".join(e[2] for e in edits)
        return sum(map(counts.__getitem__, counts.find(new))), len(new)
    tree, moved, encoded, before = SumTree(chars, tokens), 0, 0, 0
    for start, end, put in edits:
        if not before <= start <= end <= len(text) - moved:
            raise ValueError("edits must be sorted, apart and inside the text")
        before = end
        start, end = start + moved, end + moved
        moved += len(put) - (end - start)
        text = text[:start] + put + text[end:]
        if tree.levels[0][-1][0] == 0:  # nothing was left
            tree.set(0, len(text), sum(map(counts.__getitem__, counts.find(text))))
            encoded += len(text)
            continue
        first, at = tree.at(start)
        last, last_at = tree.at(max(start, end - 1))
        # one leaf with code points further back
        back = first - 1
        while back >= 0 and not tree.chars(back):
            back -= 1
        if back >= 0:
            first, at = back, at - tree.chars(back)
        stop = last_at + tree.chars(last)  # an old boundary at or after the edit
        shift = len(put) - (end - start)
        while last + 1 < tree.m and stop < end:
            last += 1
            stop += tree.chars(last)
        n, place = 0, at
        for match in counts.iter(text, at):
            n += counts[match.group()]
            place = match.end()
            while place > stop + shift and last + 1 < tree.m:
                last += 1
                stop += tree.chars(last)
            if place == stop + shift and place >= start + len(put):
                break
        encoded += place - at
        tree.set(first, place - at, n)
        for leaf in range(first + 1, last + 1):
            if tree.chars(leaf) or tree.levels[1][0][leaf]:
                tree.set(leaf, 0, 0)
    return tree.total(), encoded


def _defaults(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def build(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs with n_chars, n_tokens, leaf_chars and leaf_tokens, the tree to keep. No shuffle."""
    path, pattern = _defaults(path, pattern)
    docs = docs.drop("n_tokens", "n_chars", "leaf_chars", "leaf_tokens")
    at = docs.columns.index("text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts = counts_of(path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [x or "" for x in part.column(at).to_pylist()]
                found = [leaves(t, counts) for t in texts]
                more = [pa.array(map(len, texts), pa.int64()), pa.array([int(t.sum()) for _, t in found], pa.int64()), pa.array([c for c, _ in found], pa.list_(pa.int32())), pa.array([t for _, t in found], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, "n_chars", "n_tokens", "leaf_chars", "leaf_tokens"])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(run, f"{schema}, n_chars long, n_tokens long, leaf_chars array<int>, leaf_tokens array<int>")


def recount(trees: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_chars, n_tokens, n_tokens_edited, n_chars_reencoded of kept trees with a column `edits`."""
    path, pattern = _defaults(path, pattern)
    kind = dict(trees.dtypes)["doc_id"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts = counts_of(path, pattern)
        names = ["doc_id", "n_chars", "n_tokens", "n_tokens_edited", "n_chars_reencoded"]
        for batch in batches:
            after, encoded = [], []
            for i in range(batch.num_rows):
                chars, tokens = (np.asarray(batch.column(k)[i].values) if batch.column(k)[i].is_valid else np.zeros(0, np.int32) for k in (4, 5))
                edits = [(e["start"], e["end"], e["text"] or "") for e in batch.column(6)[i].as_py() or []]
                n, m = apply(batch.column(3)[i].as_py() or "", chars, tokens, edits, counts)
                after.append(n)
                encoded.append(m)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(after, pa.int64()), pa.array(encoded, pa.int64())], names)

    columns = trees.select("doc_id", "n_chars", "n_tokens", "text", "leaf_chars", "leaf_tokens", F.col("edits"))
    return columns.mapInArrow(run, f"doc_id {kind}, n_chars long, n_tokens long, n_tokens_edited long, n_chars_reencoded long")
