"""Byte-level BPE encoding and decoding by recursive DuckDB queries in each partition.

Each step of the recursion joins the token-position rows of the words at hand with the merge table and contracts every
word's leftmost pair of minimum rank; a word that has no pair left leaves the recursion. Every word's ids, also those of a
word that is a token itself, are then joined with the vocabulary, whose bytes an ordered aggregation puts together: a text
decodes to the bytes of its words' ids. A worker keeps the words that it has encoded, up to a bound in bytes; beyond it the
quarter goes that was asked for longest ago.

Words of more than LONG bytes take a second query that contracts all places of the pair of minimum rank in one step, where
the merge table shows that this is the same: no pair with the merged token may rank before it.

Words of more than SPAN bytes go through that query span by span, so that memory doesn't grow with the word. A sequence of tokens is
the encoding of its bytes if, and only if, each two neighbours are the encoding of theirs. The last CARRY tokens of a span are
taken back and encoded again with the bytes that follow; where a span's first token and the one before it aren't the
encoding of their bytes, more tokens are taken back.

Cases: a null or empty text has no ids (n_tokens 0, the digests of nothing). Ranks tie only between occurrences of one
merged token; the leftmost goes first. Words may have any length. Repeated rows give repeated rows. Other columns of the
input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import kept

#: Bytes of the words that a worker keeps with their ids, and what one costs beside its own bytes and ids.
CACHE, ENTRY = 80_000_000, 330
#: Bytes of text between two queries.
CHUNK = 2_500_000
#: Bytes of new words in one query.
QUERY_BYTES = 500_000
#: Longer words contract all places of a pair at once.
LONG = 48
#: Longer words are encoded in spans of as many bytes, after each of which as many tokens are open.
SPAN, CARRY = 4_096, 4


def vocabulary(path: str) -> list[tuple[bytes, int]]:
    with open(path, "rb") as f:
        return [(base64.b64decode(a), int(b)) for a, b in (line.split() for line in f if line.strip())]


def merge_rows(ranks: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """(left id, right id, merged id) of each way to put a token together from two others."""
    rows = []
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                rows.append((left, right, rank))
    return rows


#: A pick is a merged token times 2^24 and the position of its left part; words here are shorter than that.
RECURSION = """
WITH RECURSIVE step(word, tokens) USING KEY (word) AS (
    SELECT word, tokens FROM state
    UNION
    (
        WITH pair AS (
            SELECT word, unnest(tokens[:-2])::BIGINT << 32 | unnest(tokens[2:]) AS pair, unnest(range(1, len(tokens))) AS pos FROM step
        ),
        best AS (
            SELECT word, min(merged << 24 | pos) AS pick FROM pair JOIN merges USING (pair) GROUP BY word
        )
        SELECT word, tokens[:(pick & 16777215) - 1] || [(pick >> 24)::INTEGER] || tokens[(pick & 16777215) + 2:] FROM step JOIN best USING (word)
    )
)
SELECT word, tokens FROM step
"""

#: All places of the least pair at once, from the left, each token in one of them; the leftmost only if the merge isn't `alone`.
LONG_RECURSION = """
WITH RECURSIVE step(word, tokens) USING KEY (word) AS (
    SELECT word, tokens FROM state
    UNION
    (
        WITH place AS (
            SELECT word, unnest(tokens) AS token, unnest(tokens[2:]) AS follower, unnest(range(1, len(tokens) + 1)) AS pos FROM step
        ),
        hit AS (
            SELECT word, pos, merged, alone FROM place JOIN merges ON pair = (token::BIGINT << 32 | follower)
        ),
        least AS (
            SELECT word, pos, merged, alone, row_number() OVER (PARTITION BY word ORDER BY pos) AS k
            FROM hit JOIN (SELECT word, min(merged) AS merged FROM hit GROUP BY word) USING (word, merged)
        ),
        chosen AS (
            SELECT word, pos, merged FROM least WHERE alone OR k = 1
            QUALIFY row_number() OVER (PARTITION BY word, pos - k ORDER BY pos) % 2 = 1
        )
        SELECT p.word, list(coalesce(c.merged::INTEGER, p.token) ORDER BY p.pos)
        FROM place p LEFT JOIN chosen c ON c.word = p.word AND c.pos = p.pos
        WHERE p.word IN (SELECT word FROM chosen) AND NOT EXISTS (SELECT 1 FROM chosen d WHERE d.word = p.word AND d.pos + 1 = p.pos)
        GROUP BY p.word
    )
)
SELECT word, tokens FROM step
"""

#: The ids of words at their fixpoint, and the bytes that they stand for.
LINES = """
SELECT word, line, text FROM (SELECT word, array_to_string(tokens, ',') AS line FROM done) JOIN (
    SELECT word, unhex(string_agg(hex, '' ORDER BY pos)) AS text
    FROM (SELECT word, unnest(tokens) AS id, generate_subscripts(tokens, 1) AS pos FROM done) JOIN vocab USING (id) GROUP BY word
) USING (word)
"""

DECODE = """
SELECT k, string_agg(v.hex, '' ORDER BY pos) AS hex
FROM (SELECT k, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM given) JOIN vocab v USING (id) GROUP BY k
"""


class Codec:
    """The merge table and the vocabulary in a DuckDB of one worker, and the words that it has encoded."""

    def __init__(self, path: str):
        import duckdb
        import pyarrow as pa

        self.pa = pa
        pairs = vocabulary(path)
        ranks = dict(pairs)
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.whole = ranks
        # no temp folder: queries are small, and nothing may spill to a machine's own disk
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": ""})
        rows = merge_rows(ranks)
        least: dict[int, int] = {}
        for left, right, merged in rows:
            least[left] = min(merged, least.get(left, merged))
            least[right] = min(merged, least.get(right, merged))
        alone = [least.get(m, m) >= m for _, _, m in rows]
        merges = pa.table({"pair": pa.array([a << 32 | b for a, b, _ in rows], pa.int64()), "merged": pa.array([r[2] for r in rows], pa.int64()), "alone": pa.array(alone, pa.bool_())})
        words = pa.table({"id": pa.array([r for _, r in pairs], pa.int32()), "hex": [t.hex() for t, _ in pairs]})
        self.con.register("given_merges", merges)
        self.con.register("given_vocab", words)
        self.con.execute("CREATE TABLE merges AS SELECT * FROM given_merges")
        self.con.execute("CREATE TABLE vocab AS SELECT * FROM given_vocab")
        #: word to its ids, written with commas, and the bytes that these decode to; those asked for last come last
        self.known: dict[str, tuple[str, bytes]] = {}
        self.held, self.cache = 0, CACHE

    def contract(self, words: list[bytes], whole: bool = False, long: bool = False) -> list[tuple[str, bytes]]:
        """The ids of each word, written with commas, and the bytes that these decode to. whole: all words are tokens, which stay so."""
        import numpy as np

        pa, single = self.pa, np.asarray(self.single, np.int32)
        if whole:
            cuts, tokens = np.arange(len(words) + 1), np.array([self.whole[w] for w in words], np.int32)
        else:
            cuts, tokens = np.cumsum([0, *map(len, words)]), single[np.frombuffer(b"".join(words), np.uint8)]
        state = pa.table({"word": pa.array(np.arange(len(words)), pa.int32()), "tokens": pa.LargeListArray.from_arrays(cuts, tokens)})
        self.con.register("state", state)
        self.con.execute(f"CREATE OR REPLACE TEMP TABLE done AS {LONG_RECURSION if long else RECURSION}")
        self.con.unregister("state")
        got = self.con.sql(LINES).to_arrow_table()
        out: list[tuple[str, bytes]] = [("", b"")] * len(words)
        for w, line, text in zip(got["word"].to_pylist(), got["line"].to_pylist(), got["text"].to_pylist()):
            out[w] = line, text
        return out

    def _ids(self, words: list[bytes]) -> list[list[int]]:
        return [list(map(int, line.split(","))) for line, _ in self.contract(words, long=True)]

    def spans(self, word: bytes) -> list[int]:
        """The ids of a word of any length, with the memory of a span: see the module's text."""
        if not hasattr(self, "bytes_of"):
            self.bytes_of = {i: t for t, i in self.whole.items()}
        out: list[int] = []
        lo, open_ = 0, CARRY
        agree: dict[tuple[int, int], bool] = {}
        buffer = b""
        while True:
            part = word[lo : lo + SPAN]
            lo += len(part)
            buffer += part
            while True:
                ids = self._ids([buffer])[0]
                if out:
                    pair = (out[-1], ids[0])
                    if pair not in agree:
                        agree[pair] = self._ids([self.bytes_of[pair[0]] + self.bytes_of[pair[1]]])[0] == list(pair)
                    if not agree[pair]:
                        back = out[-open_:]
                        del out[-open_:]
                        buffer = b"".join(map(self.bytes_of.__getitem__, back)) + buffer
                        open_ *= 2
                        continue
                break
            if lo >= len(word):
                return out + ids
            keep = max(0, len(ids) - CARRY)
            out += ids[:keep]
            buffer = b"".join(map(self.bytes_of.__getitem__, ids[keep:]))
            open_ = CARRY

    def learn(self, words) -> None:
        """Encodes new words and keeps their ids and what these decode to."""
        raws = {w: w.encode() for w in words}
        alike: dict[tuple[bool, bool], list[str]] = {}
        for word, raw in raws.items():
            if len(raw) > SPAN and raw not in self.whole:
                ids = self.spans(raw)
                self.known[word] = ",".join(map(str, ids)), self.decode([ids])[0]
                self.held += ENTRY + 4 * len(raw)
                continue
            alike.setdefault((raw in self.whole, len(raw) > LONG), []).append(word)
        for (whole, long), some in alike.items():
            some.sort(key=lambda w: len(raws[w]))
            lo = 0
            while lo < len(some):
                total, hi = 0, lo
                while hi < len(some) and (hi == lo or total + len(raws[some[hi]]) <= QUERY_BYTES):
                    total += len(raws[some[hi]])
                    hi += 1
                self.known.update(zip(some[lo:hi], self.contract([raws[w] for w in some[lo:hi]], whole, long)))
                self.held += ENTRY * (hi - lo) + 4 * total
                lo = hi

    def ready(self, asked: set[str]) -> None:
        """Learns what is new of the words asked for; before, if there would be too many, a quarter of the others goes."""
        known = self.known
        fresh = asked.difference(known)
        for word in asked.intersection(known):
            known[word] = known.pop(word)
        if self.held + ENTRY * len(fresh) > self.cache:
            old = list(known)
            for word in old[: len(old) // 4]:
                if word not in asked:
                    del known[word]
            self.known = dict(known)
            self.held = sum(ENTRY + 4 * len(x) for _, x in self.known.values())
        if fresh:
            self.learn(fresh)

    def decode(self, sequences: list[list[int]]) -> list[bytes]:
        """The bytes of each sequence of ids, put together by an ordered aggregation."""
        self.con.register("given", self.pa.table({"k": self.pa.array(range(len(sequences)), self.pa.int32()), "ids": self.pa.array(sequences, self.pa.list_(self.pa.int32()))}))
        got = self.con.sql(DECODE).to_arrow_table()
        self.con.unregister("given")
        out = [b""] * len(sequences)
        for k, text in zip(got["k"].to_pylist(), got["hex"].to_pylist()):
            out[k] = bytes.fromhex(text)
        return out


def encode_batches(batches: Iterator, path: str, pattern: str, emit_ids: bool, cache: int = CACHE) -> Iterator:
    """Arrow batches (doc_id, text) with the digests of each text; with emit_ids also its ids."""
    import pyarrow as pa
    import regex

    find = regex.compile(pattern).findall
    for batch in batches:
        docs, texts = batch.column(0), batch.column(1)
        codec = kept(("bpe", path), lambda: Codec(path))
        codec.cache = cache
        lo = 0
        while lo < len(texts):
            words, total, hi = [], 0, lo
            while hi < len(texts) and (hi == lo or total < CHUNK):
                text = texts[hi].as_py() or ""
                words.append(find(text))
                total += len(text)
                hi += 1
            codec.ready(set().union(*words))
            of = codec.known.__getitem__
            n, ids_sha, decoded_sha, ids = [], [], [], []
            for w in words:
                lines, parts = zip(*map(of, w)) if w else ((), ())
                line = ",".join(lines)
                n.append(line.count(",") + 1 if line else 0)
                ids_sha.append(hashlib.sha256(line.encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(b"".join(parts)).hexdigest())
                if emit_ids:
                    ids.append(list(map(int, line.split(","))) if line else [])
            columns = [docs.slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if emit_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
            lo = hi


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, emit_ids: bool = False, cache: int = CACHE) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, and with emit_ids the ids themselves.

    path: a file of ranks in tiktoken's format that every executor has; by default byte_bpe_multi_50k of the installed
    public tokenizers. pattern: what a word of the text is. cache: bytes of encoded words that a worker keeps. No shuffle: each
    partition works alone.
    """
    import public_tokenizers

    path, pattern = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * emit_ids
    return docs.select("doc_id", docs["text"].cast("string")).mapInArrow(lambda it: encode_batches(it, path, pattern, emit_ids, cache), schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and decoded, the bytes of the ids of each row; null ids give no bytes. An id that isn't in the ranks is an error."""
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def run(batches):
        import pyarrow as pa

        codec = kept(("bpe", path), lambda: Codec(path))
        known = set(codec.whole.values())
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = [x or [] for x in part.column(1).to_pylist()]
                if unknown := {i for x in ids for i in x} - known:
                    raise ValueError(f"ids outside the vocabulary: {sorted(map(str, unknown))[:5]}")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(codec.decode(ids), pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, decoded binary")
