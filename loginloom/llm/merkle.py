"""Document fingerprints: a Merkle tree over sections, paragraphs and sentences.

A text is cut at blank lines into sections, at line ends into paragraphs and after sentence marks into pieces of bounded
length; every cut is decided by the text around it alone, so an edit changes the pieces that it touches and no others. A
leaf's digest is of its piece's bytes, a node's of its children's digests. Equal roots mean equal texts; where they differ,
`compare` descends into differing branches only and gives the spans that were edited.

A fingerprint is the root digest, a colon, and the tree with four bytes of each inner digest and three of each leaf's. The
likeness of two fingerprints is the share of leaves that they have in common, counted with repeats (2 * common / all), and 1 for
equal ones; it descends both trees and enters only branches that differ.

Cases: a null text counts as empty; the empty text has a root and no leaf, and likeness 0 to any other text. Very long
lines are cut every PIECE code points. Repeated rows give repeated rows; ties of doc_id are ordered by the text.
Null doc_ids come first. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The longest piece, in code points.
PIECE = 48
#: A sentence ends after its mark and white space, or with the line.
SENTENCE = re.compile(r"(?:[^.!?\n]+|[.!?](?!\s))*(?:[.!?]\s|\n)?")


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def pieces(text: str) -> list[str]:
    """The leaves' texts; joined they are the text."""
    out = []
    for x in SENTENCE.findall(text):
        if len(x) <= PIECE:
            if x:
                out.append(x)
        else:
            out += [x[i : i + PIECE] for i in range(0, len(x), PIECE)]
    return out


def tree(text: str) -> list[list[list[bytes]]]:
    """sections of paragraphs of leaf digests."""
    sections: list[list[list[bytes]]] = [[[]]] if text else []
    ended = blank = False
    for piece in pieces(text):
        if ended:
            if blank and piece != "\n":
                sections.append([])
            sections[-1].append([])
        sections[-1][-1].append(digest(piece.encode("utf-8", "surrogatepass")))
        ended = piece.endswith("\n")
        blank = piece == "\n" or (blank and not ended)
    return sections


def node(children: list[bytes], level: bytes) -> bytes:
    return digest(level + b"".join(children))


def fingerprint(text: str) -> str:
    """The root, a colon, and the tree: each section's digest with its paragraphs in brackets, each paragraph's with its leaves."""
    root, parts = [], []
    for s in tree(text):
        own, inner = [], []
        for leaves in s:
            own.append(node(leaves, b"p"))
            inner.append(own[-1][:4].hex() + "(" + "".join(leaf[:3].hex() for leaf in leaves) + ")")
        root.append(node(own, b"s"))
        parts.append(root[-1][:4].hex() + "[" + "".join(inner) + "]")
    return node(root, b"d").hex() + ":" + "".join(parts)


def branches(body: str, closing: str) -> Counter:
    """How often each child stands in a node's body: sections end in `]`, paragraphs in `)`."""
    return Counter(x + closing for x in body.split(closing)[:-1])


def _paragraphs(sections: Counter) -> Counter:
    out: Counter = Counter()
    for section, n in sections.items():
        for paragraph, k in branches(section[9:-1], ")").items():
            out[paragraph] += n * k
    return out


def _leaves(children: Counter) -> Counter:
    """The leaves under paragraphs, counted."""
    out: Counter = Counter()
    for child, n in children.items():
        text = child[9:-1]
        for i in range(0, len(text), 6):
            out[text[i : i + 6]] += n
    return out


def _size(children: Counter, sections: bool) -> int:
    """How many leaves lie under the children, without cutting them apart."""
    total = 0
    for child, n in children.items():
        marks = child.count("(")
        total += n * ((len(child) - 10 - 10 * marks if sections else len(child) - 10) // 6)
    return total


def likeness(a: str, b: str) -> float:
    """From 0, no leaf in common, to 1, equal: the share of common leaves, counted with repeats.

    The trees are compared from the root: children that both sides have are common as a whole and are not entered; only those
    that differ are compared at the next level. As what is taken as common is taken off both sides, the share is that of all leaves.
    """
    if a.partition(":")[0] == b.partition(":")[0]:
        return 1.0
    x, y = (branches(f.partition(":")[2], "]") for f in (a, b))
    n = _size(x, True) + _size(y, True)
    if not n:
        return 0.0
    both = x & y
    common = _size(both, True)
    x, y = _paragraphs(x - both), _paragraphs(y - both)
    both = x & y
    common += _size(both, False)
    common += (_leaves(x - both) & _leaves(y - both)).total()
    return 2 * common / n


def compare(a: str, b: str) -> list[tuple[int, int]]:
    """Spans (start, end) of a's code points that lie in leaves without an equal in b; [] for equal texts.

    Subtrees of a whose digest b also has are skipped whole.
    """
    ta, tb = tree(a), tree(b)
    if ta == tb:
        return []
    has_section = {node([node(p, b"p") for p in s], b"s") for s in tb}
    has_par = {node(p, b"p") for s in tb for p in s}
    has_leaf = {leaf for s in tb for p in s for leaf in p}
    out: list[tuple[int, int]] = []
    at, texts = 0, iter(pieces(a))
    for s in ta:
        same_section = node([node(p, b"p") for p in s], b"s") in has_section
        for p in s:
            same = same_section or node(p, b"p") in has_par
            for leaf in p:
                end = at + len(next(texts))
                if not same and leaf not in has_leaf:
                    if out and out[-1][1] == at:
                        out[-1] = (out[-1][0], end)
                    else:
                        out.append((at, end))
                at = end
    return out


def successors(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, tail, doc_id, text: doc_id ranges, each followed by the first document of the next (tail), the last by the first of all.

    The bounds are doc_ids of the table, from a bounded summary; a row goes to one bucket, a bound's row to two.
    """
    cuts = F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)] or [0.5], 20 * buckets)
    smallest, cuts, nulls = docs.agg(F.min("doc_id"), cuts, F.max(F.col("doc_id").isNull())).first()
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    first = None if nulls else smallest
    bounds = [first] if smallest is None else [first, *sorted({c for c in cuts or [] if c > smallest})]
    known = [b for b in bounds if b is not None]
    bucket = F.lit(0)
    if len(bounds) > 1:
        cuts = F.array(*[F.lit(b) for b in bounds[1:]])
        bucket = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.size(F.filter(cuts, lambda b: b <= F.col("doc_id"))))
    rows = rows.withColumn("bucket", bucket.cast("int"))
    is_bound = F.col("doc_id").isin(known) if first is not None else (F.col("doc_id").isNull() | F.col("doc_id").isin(known))
    before = F.pmod(F.col("bucket") - 1, F.lit(len(bounds))).cast("int")
    places = F.when(is_bound, F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("tail")), F.struct(before.alias("bucket"), F.lit(1).alias("tail")))).otherwise(F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("tail"))))
    return rows.withColumn("place", F.explode(places)).select("place.bucket", "place.tail", "doc_id", "text")


def fingerprint_batches(batches: Iterator) -> Iterator:
    """Rows in order of bucket, tail, doc_id: each row but the tail's, compared with the one that follows."""
    import pyarrow as pa

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    held = None  # bucket, doc_id, text, fingerprint of the row before
    rows: list[tuple] = []
    size = 0

    def flush():
        columns = list(zip(*rows))
        kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    id_type = pa.int64()
    for batch in batches:
        id_type = batch.column(2).type
        buckets, tails, ids = (batch.column(i).to_pylist() for i in range(3))
        for i, (bucket, tail, doc_id) in enumerate(zip(buckets, tails, ids)):
            text = batch.column(3)[i].as_py()
            own = fingerprint(text) if not tail or held is not None and held[0] == bucket else ""
            if held is not None and held[0] == bucket and not held[4]:
                _, before, old, mark, _ = held
                quarter = len(old) // 4
                edited = old[: len(old) - quarter] + text[:quarter]
                changed = fingerprint(edited)
                sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((before, len(old), sha, mark, changed, likeness(mark, changed), likeness(mark, own)))
                size += len(mark) + len(changed)
                if size > 4_000_000:
                    yield flush()
                    rows, size = [], 0
            held = (bucket, doc_id, text, own, tail)
    if rows:
        yield flush()


def fingerprints(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every whole text.

    The edited text has its last quarter replaced by as much of the start of the next document. One shuffle of the texts,
    by ranges of doc_id.
    """
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions")) * 4
    rows = successors(docs, buckets)
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket").sortWithinPartitions("bucket", "tail", "doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"]
    return dealt.mapInArrow(fingerprint_batches, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
