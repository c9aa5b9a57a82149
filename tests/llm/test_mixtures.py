"""Tokenizer alignment, whitening and mixing against brute-force versions."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import alignment, mixing, whitening

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# --- alignment ------------------------------------------------------------------------------------------------------------

def align_plainly(texts):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, sha), token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte_of, extra = {}, 0
    for x in range(256):
        if 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255:
            byte_of[chr(x)] = x
        else:
            byte_of[chr(256 + extra)] = x
            extra += 1
    total, per = Counter(), []
    for t in texts:
        t = t or ""
        ids_a = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ids_b = b.encode(t) if t else []
        bytes_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if b"".join(bytes_a) != (" " + t).encode() or b"".join(bytes_b) != (" " + t).encode():
            ids_a, ids_b, bytes_a, bytes_b = [], [], [], []
        spans = []
        for parts in (bytes_a, bytes_b):
            at, out = 0, []
            for p in parts:
                out.append((at, at + len(p)))
                at += len(p)
            spans.append(out)
        cuts = {e for _, e in spans[0]} & {e for _, e in spans[1]}
        sides = []
        for ids, sp in ((ids_a, spans[0]), (ids_b, spans[1])):
            run, out = [], []
            for i, (_, e) in zip(ids, sp):
                run.append(str(i))
                if e in cuts:
                    out.append(",".join(run))
                    run = []
            sides.append(out)
        groups = ["|".join(g) for g in zip(*sides, strict=True)]
        links, j = [], 0
        for i, (s, e) in zip(ids_a, spans[0]):
            while j and spans[1][j - 1][1] > s:
                j -= 1
            k = j
            while k < len(ids_b) and spans[1][k][0] < e:
                if spans[1][k][1] > s:
                    links.append((i, ids_b[k]))
                k += 1
            j = k
        total.update(links)
        per.append((len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    most = defaultdict(int)
    for (_, y), n in total.items():
        most[y] = max(most[y], n)
    return [(na, nb, g, len(ls), sum(total[x] == most[x[1]] for x in ls), sum(total[x] for x in ls), sha) for na, nb, g, ls, sha in per]


FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("block", [1 << 9, 1 << 20])
def test_alignment_matches_token_by_token(spark, odd, block):
    more = spark.createDataFrame([(100, "a  b   c"), (101, " leading and trailing "), (102, "<s> </s> <0x41> <|endoftext|>"), (103, "tab\tand\nnewline"),
                                  (104, "naïve café — “quotes” ﬁ ligature"), (105, "日本語のテキスト"), (106, "▁ under"), (107, " "), (107, " ")], "doc_id bigint, text string")
    docs = odd.select("doc_id", "text", "key", "bucket").unionByName(more, allowMissingColumns=True)
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = Counter((i, *rest) for (i, _), rest in zip(texts, align_plainly([t for _, t in texts]), strict=True))
    got = Counter((r.doc_id, *(r[f] for f in FIELDS)) for r in alignment.aligned(docs, A, B, block_bytes=block).collect())
    assert got == want


def test_alignment_of_the_small_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = Counter((i, *rest) for (i, _), rest in zip(texts, align_plainly([t for _, t in texts]), strict=True))
    assert Counter((r.doc_id, *(r[f] for f in FIELDS)) for r in alignment.aligned(docs, A, B).collect()) == want


def test_alignment_without_rows_or_tokens(spark, empty):
    assert alignment.aligned(empty, A, B).collect() == []
    none = spark.createDataFrame([(1, None), (None, "")], "doc_id bigint, text string")
    assert {tuple(r)[1:] for r in alignment.aligned(none, A, B).collect()} == {(0, 0, 0, 0, 0, 0, "")}


# --- whitening ------------------------------------------------------------------------------------------------------------

def whiten_plainly(rows, weights, components=16):
    x = {k: np.floor(64 * np.array(v, dtype=float)).astype(np.int64) + 1_000_000 for k, v in rows}
    counts = Counter(tuple(v) for v in x.values())
    fit = np.array(sorted(counts), dtype=np.int64)
    w = np.array([1 if weights == "one" else counts[tuple(v)] for v in fit])
    n, s = int(w.sum()), (fit * w[:, None]).sum(axis=0)
    c = (n * fit - s) / n
    cov = (c * w[:, None]).T @ c / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    return {k: (n, sum(int(d) ** 2 for d in n * v - s), (n * v - s) / n @ axes / np.sqrt(values)) for k, v in x.items()}, values / np.trace(cov)


@pytest.mark.parametrize("weights", ["one", "count"])
def test_whitening_matches_numpy(spark, weights):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 20)) @ np.diag(np.linspace(3, 0.3, 20))
    rows = [(i, base[i if i < 300 else 7].astype(np.float32).tolist()) for i in range(450)]  # a third are copies
    odd = [(900, None), (901, [None] + [1.0] * 19), (902, [float("nan")] * 20), (903, [float("inf")] + [0.0] * 19), (904, [])]
    df = spark.createDataFrame([(i, v, "x", 3, [1.0]) for i, v in rows + odd], "vec_id bigint, embedding array<float>, x string, n int, z array<double>").repartition(5)
    got = whitening.whiten(df, weights=weights).collect()
    want, shares = whiten_plainly(rows, weights)
    assert len(got) == 450 * 16
    found = defaultdict(dict)
    for r in got:
        n, deviation, z = want[r.vec_id]
        assert (r.n, r.deviation) == (n, deviation) and abs(r.explained - shares[r.component - 1]) < 1e-9 and r.identity_error < 1e-9
        found[r.component][r.vec_id] = (r.whitened, z[r.component - 1])
    for pairs in found.values():
        a, b = np.array(list(pairs.values())).T
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8


def test_whitening_of_the_small_table(spark, folder):
    df = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect() if r.embedding and all(v is not None and np.isfinite(v) for v in r.embedding)]
    want, shares = whiten_plainly(rows, "one")
    got = whitening.whiten(df).collect()
    assert len(got) == 16 * len(rows)
    for r in got:
        n, deviation, z = want[r.vec_id]
        assert (r.n, r.deviation) == (n, deviation) and abs(abs(r.whitened) - abs(z[r.component - 1])) < 1e-7
        assert abs(r.explained / shares[r.component - 1] - 1) < 1e-6 and r.identity_error < 1e-8


def test_whitening_without_variance(spark):
    schema = "vec_id bigint, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).collect() == []
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0])], schema)).collect()
    assert sorted((r.vec_id is None, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one) == [
        (a, c, 1, 0, None, 0.0, None) for a in (False, True) for c in (1, 2, 3)]
    two = whitening.whiten(spark.createDataFrame([(1, [0.0, 5.0]), (2, [4.0, 5.0])], schema)).collect()
    assert {(r.component, r.vec_id, None if r.whitened is None else round(abs(r.whitened), 9), r.explained) for r in two} == {
        (1, 1, 1.0, 1.0), (1, 2, 1.0, 1.0), (2, 1, None, 0.0), (2, 2, None, 0.0)}
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([(1, [0.0]), (2, [4.0, 5.0])], schema))
    far = spark.createDataFrame([(1, [2.0 ** 23]), (2, [-(2.0 ** 23)]), (3, [0.0])], schema)
    assert {r.deviation for r in whitening.whiten(far).collect()} == {0, (3 * 2 ** 29) ** 2}


# --- mixing ---------------------------------------------------------------------------------------------------------------

def targets_plainly(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, at_cap = sum(sizes.values()), set()
    while True:
        left, w = total - sum(3 * sizes[s] for s in at_cap), sum(weight[s] for s in order if s not in at_cap)
        share = {s: 3.0 * sizes[s] if s in at_cap else left * weight[s] / w for s in order}
        over = {s for s in order if s not in at_cap and share[s] > 3 * sizes[s]}
        if not over:
            return share
        at_cap |= over


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def check_mix(docs, got, near):
    text = {(r.doc_id, r.source): r for r in docs}
    sizes = defaultdict(int)
    for r in docs:
        sizes[r.source] += words(r.text)
    want, taken = targets_plainly(sizes), defaultdict(int)
    assert len(got) == len(docs)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r.doc_id, words(r.text)) for r in docs)
    for r in got:
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
    by_id = {r.doc_id: r.source for r in docs}
    if len(by_id) == len(docs):
        for r in got:
            s = by_id[r.doc_id]
            assert r.source_size == sizes[s] and abs(r.target - want[s]) <= 1e-9 * max(1.0, want[s])
            taken[s] += r.taken
        for s in sizes:
            assert abs(taken[s] - want[s]) <= near(s), (s, taken[s], want[s])
    return text


def test_mix_of_the_small_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = mixing.mix(docs).collect()
    check_mix(docs.collect(), got, lambda s: 50)
    again = mixing.mix(docs.repartition(13)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mix_with_caps_and_hot_source(spark):
    rows = [(i, "w " * (1 + i % 37), "hot") for i in range(3000)] + [(5000 + i, "w x", "a") for i in range(4)] + [(6000, "w " * 900, "b"), (6001, "w", "b")]
    rows += [(7000 + i, "w " * (i % 5), None) for i in range(50)] + [(8000, None, "none"), (8001, "", "none")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    check_mix(docs.collect(), mixing.mix(docs).collect(), lambda s: 1)


def test_mix_matches_the_tilted_rates(spark):
    """Before rounding: rates min(3, exp(tilt * z)) whose words meet the target."""
    rng = np.random.default_rng(1)
    hist = [(p, int(z), int(n)) for p in "sa sb sc sd".split() for z, n in zip(rng.choice(np.arange(1, 5000), 60, replace=False), rng.integers(1, 50, 60), strict=True)]
    sizes = spark.createDataFrame(hist, "part string, z bigint, n bigint")
    total = {p: sum(z * n for q, z, n in hist if q == p) for p in "sa sb sc sd".split()}
    goal = {"sa": total["sa"] * 0.01, "sb": total["sb"] * 2.9, "sc": total["sc"] * 1.0, "sd": total["sd"] * 3.0}
    targets = spark.createDataFrame([(p, total[p], float(goal[p])) for p in goal], "part string, s bigint, target double")
    tilts = {r.part: r.tilt for r in mixing.balance(sizes, targets).collect()}
    assert set(tilts) == {"sa", "sb", "sc"}
    for p, tilt in tilts.items():
        assert abs(sum(z * n * min(3.0, np.exp(tilt * z)) for q, z, n in hist if q == p) / goal[p] - 1) < 1e-10


def test_mix_of_odd_rows(spark, odd, empty):
    check_mix(odd.collect(), mixing.mix(odd).collect(), lambda s: 1e18)
    assert mixing.mix(empty).collect() == []
    none = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id bigint, text string, source string")
    assert sorted(tuple(r) for r in mixing.mix(none).collect()) == [(1, 0, 0, 0.0, 0, 0), (2, 0, 0, 0.0, 0, 0)]
