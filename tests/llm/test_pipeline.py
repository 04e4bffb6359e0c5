"""The five stages in a row and run() against plain Python on a small corpus."""

import base64
import hashlib
import random
from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline
from loginloom.llm import mixing, quality
from loginloom.llm.common import table

from .test_exact import _components


def _corpus():
    rnd = random.Random(12)
    words = [f"{a}{b}" for a in ("lo", "mi", "ra", "te", "vu", "su") for b in ("ka", "ne", "pol", "rin", "sta", "tum")]
    passage = " ".join(rnd.choices(words, k=40))
    rows = []
    for i in range(60):
        text = " ".join(rnd.choices(words, k=rnd.randint(30, 120))).capitalize() + "."
        if i % 6 == 0:
            text += " " + passage + " " + rnd.choice(words)
        rows.append((i, text, "en", f"src{i % 3}", len(text)))
    for i in range(60, 70):  # near copies of documents without the passage
        copied = rows[i - 60 + 1 if (i - 60) % 6 == 0 else i - 60][1].split()
        copied[0] = "Changed"
        rows.append((i, " ".join(copied), "en", "src1", 1))
    junk = [(i, "@@## $$ %% " * rnd.randint(10, 30), "en", "src2", 1) for i in range(70, 90)]
    return rows + junk


def test_stages_and_run_equal_plain_python(spark, tmp_path):
    rows = _corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k < 70), 0) for k, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf = str(tmp_path)
    docs = table(spark, sf, "documents")

    kept = docs
    held = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept, sf).write.parquet(str(tmp_path / f"s{n}"))
        kept = spark.read.parquet(str(tmp_path / f"s{n}"))
        held.append([tuple(r) for r in kept.collect()])

    # 1: the scores decide; junk goes, prose stays
    scores = {r.doc_id: r.quality_score for r in quality.score(docs, quality.fit(docs, table(spark, sf, "labels"))).collect()}
    assert sorted(r[0] for r in held[0]) == sorted(k for k, y in scores.items() if y >= 0.5)
    assert {k for k in scores if k < 60} <= {r[0] for r in held[0]} and not {r[0] for r in held[0]} & set(range(70, 90))

    # 2: the least document of each component
    texts = sorted((r[0], r[1]) for r in held[0])
    component, _ = _components(texts)
    assert sorted(r[0] for r in held[1]) == sorted(k for i, (k, _) in enumerate(texts) if component[i] == k)
    assert len(held[1]) < len(held[0])

    # 3: bytes that an earlier place holds too
    seen, want = set(), {}
    for k, text in sorted((r[0], r[1]) for r in held[1]):
        data = text.encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(data[i : i + 100])
        left = bytes(c for c, g in zip(data, gone) if not g).decode(errors="ignore")
        if left or not data:
            want[k] = left
    assert {r[0]: r[1] for r in held[2]} == want and any(len(want[k]) < len(t) for k, t in texts if k in want)
    assert all(r[4] == len(r[1]) for r in held[2])

    # 4: as many copies as the mix takes
    third = spark.read.parquet(str(tmp_path / "s2"))
    copies = {r.doc_id: len(r.mix_places) for r in mixing.mix(third).collect()}
    assert Counter(r[0] for r in held[3]) == Counter({k: n for k, n in copies.items() if n})
    assert {r[0]: r[1] for r in held[3]} == {k: want[k] for k, n in copies.items() if n}

    # 5: the tokens of every text that is left
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    sha = lambda x: hashlib.sha256(x).hexdigest()
    last = sorted((r[0], len(encode(r[1])), sha(",".join(map(str, encode(r[1]))).encode()), sha(r[1].encode())) for r in held[3])
    assert sorted(held[4]) == last
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == last
