"""Archives, shards, packing, near-duplicates, components and code search against brute-force versions."""

import base64
import hashlib
import io
import tempfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import components, hamming, packing, sharding, simhash, warc


# --- archives -------------------------------------------------------------------------------------------------------------

def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.mark.parametrize("least", [0, 20])
def test_archive_round_trip(spark, least):
    pages = [(1, "u1", "same page body, long enough"), (2, "u2", "other"), (3, None, "same page body, long enough"), (4, "u4", ""), (5, "u5", None),
             (5, "u5", None), (None, "u6", "same page body, long enough"), (7, "u\n7", "é" * 40_000), (8, "u8", "no id twin"), (0, "u0", "other")]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id bigint, url string, html string, payload string, record_type int")
    got = warc.archive_and_read(df, least_bytes=least).collect()
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = Counter()
    for i, _, h in pages:
        h = h or ""
        copy = len(h.encode()) >= least and h in first and (i is None or i > first[h])
        want[(i, len(h.encode()), sha(h), "revisit" if copy else "response", first[h] if copy else None)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert warc.archive_and_read(df.limit(0)).count() == 0


def test_archive_filters_and_payloads(spark):
    warc.register(spark)
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = [("response", f"<urn:page:{i}>", f"http://h{i % 2}/x", "2024-01-01T00:00:00Z", None, f"body {i}".encode()) for i in range(20)]
    df = spark.createDataFrame(rows, "record_type string, record_id string, target_uri string, warc_date string, refers_to string, payload binary")
    df.repartition(2).write.format("warc").option("path", path).mode("append").save()
    back = spark.read.format("warc").option("path", path).option("payload", "true").load()
    assert back.where("record_type = 'warcinfo'").count() == 2
    some = back.where("record_type = 'response' and target_uri like 'http://h1%'")
    assert {bytes(r.payload) for r in some.collect()} == {f"body {i}".encode() for i in range(1, 20, 2)}
    assert back.where("record_id in ('<urn:page:3>', '<urn:page:4>') and payload_bytes = 6").count() == 2
    df.limit(3).write.format("warc").option("path", path).mode("overwrite").save()
    assert spark.read.format("warc").option("path", path).load().where("record_type = 'response'").count() == 3


class Counting(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        data = super().read(n)
        self.taken += len(data)
        return data


def test_unwanted_payloads_are_not_read():
    noise = np.random.default_rng(1).integers(0, 256, 400_000, dtype=np.uint8).tobytes()
    block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(noise) + noise
    one = warc.record("response", "<urn:page:1>", "http://x", "d", "application/http; msgtype=response", block)
    packed = warc.pack(one, 3) * 5
    file = Counting(packed)
    assert not list(warc.read_records(file, len(packed), lambda c: False, True, True)) and file.taken < len(packed) / 3
    plain = zlib.compressobj(6, zlib.DEFLATED, 31)
    bare = (plain.compress(one) + plain.flush()) * 3  # no size in the header: read through
    found = list(warc.read_records(io.BytesIO(bare), len(bare), lambda c: True, True, False))
    assert len(found) == 3 and found[2][-1] == noise
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(packed[:-9]), len(packed) - 9, lambda c: True, True, False))


def test_members_with_several_records_and_plain_archives():
    some = [warc.record("response", f"<urn:page:{i}>", "", "d", "application/http", b"HTTP/1.1 200 OK\r\nContent-Length: 6\r\n\r\nbody %d" % i) for i in range(9)]
    for join in (lambda r: b"".join(map(lambda k: warc.pack(b"".join(r[k:k + 3]), 3), (0, 3, 6))), lambda r: b"".join(r)):
        data = join(some)
        read = lambda wanted, data=data: list(warc.read_records(io.BytesIO(data), len(data), wanted, True, False, data[:2] == b"\x1f\x8b"))
        assert [r[-1] for r in read(lambda c: True)] == [b"body %d" % i for i in range(9)]
        assert [r[-1] for r in read(lambda c: c["record_id"][-2] in "147")] == [b"body 1", b"body 4", b"body 7"]
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(data[:-9]), len(data) - 9, lambda c: False, True, False, data[:2] == b"\x1f\x8b"))


def test_chunked_bodies_and_long_records():
    body = b"5\r\nhello\r\n6;x=1\r\n world\r\n0\r\n\r\n"
    one = warc.record("response", "a", "", "d", "application/http", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + body)
    assert list(warc.read_records(io.BytesIO(one), len(one), lambda c: True, True, False, False))[0][-2:] == (11, b"hello world")
    assert warc.unchunked(b"not chunked") == b"not chunked" and warc.unchunked(b"5\r\nhel") == b"5\r\nhel"
    long = b"x" * 70_000_000
    packed = warc.pack(warc.record("resource", "b", "", "d", "text/plain", long), 1) + warc.pack(one, 1)
    assert [r[-2] for r in warc.read_records(io.BytesIO(packed), len(packed), lambda c: True, True, False)] == [len(long), 11]


def test_archive_folders(spark):
    warc.register(spark)
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    df = spark.createDataFrame([("response", "r1", "u", "d", None, b"one")], "record_type string, record_id string, target_uri string, warc_date string, refers_to string, payload binary")
    slow = warc.WarcWriter({"path": path}, False)  # another append that is still running
    slow.write(iter(df.toArrow().to_batches()))
    df.write.format("warc").option("path", path).mode("append").save()
    read = lambda: sorted(bytes(r.payload) for r in spark.read.format("warc").option("path", path).load().where("record_type = 'response'").collect())
    assert read() == [b"one"]
    message = slow.write(iter(df.toArrow().to_batches()))
    slow.commit([message])
    assert read() == [b"one", b"one"]
    df.write.format("warc").option("path", path).mode("overwrite").save()
    assert read() == [b"one"]
    with open(f"{path}/plain.warc", "wb") as f:
        f.write(warc.record("response", "r2", "", "d", "text/plain", b"two"))
    assert read() == [b"one", b"two"]
    with open(f"{path}/notes.txt", "w") as f:
        f.write("no archive")
    with pytest.raises(Exception, match="not an archive"):
        read()


# --- shards ---------------------------------------------------------------------------------------------------------------

def test_shards(spark, odd, empty):
    rows = [(i, "t" * (i % 50), "big" if i % 3 else f"s{i % 90}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = sharding.interleave(df, 8).collect()
    assert sorted(r.doc_id for r in got) == list(range(3000))
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
    assert {len(s) for s in shards.values()} == {375}
    assert all(sorted(r.slot for r in s) == list(range(375)) for s in shards.values())
    mixture = Counter(r.stratum for r in got)
    for s in shards.values():
        inside = Counter(r.stratum for r in s)
        # under a row at either cut, and of the largest stratum what the 30 others round together
        assert all(abs(inside[k] - n / 8) < (8 if k == "big" else 2) for k, n in mixture.items())
    # the same as sorting everything in one place
    parts = defaultdict(list)
    for i, _, source in rows:
        draw = int(hashlib.md5(f"42:{i}".encode()).hexdigest()[:15], 16)
        parts["s" + source].append((draw, i))
    order = []
    for part, items in parts.items():
        u = int(hashlib.md5(f"42:offset:{part}".encode()).hexdigest()[:13], 16) / 2 ** 52
        order += [((k + u) / len(items), part, i) for k, (_, i) in enumerate(sorted(items))]
    assert {r.doc_id: r.shard for r in got} == {i: g * 8 // 3000 for g, (_, _, i) in enumerate(sorted(order))}
    dealt = sharding.interleave(odd, 8).collect()
    assert len(dealt) == odd.count() and sorted(r.size for r in dealt) == sorted(len((r.text or "").encode()) + 1 for r in odd.collect())
    assert sharding.interleave(empty, 8).count() == 0


# --- best fit by its rules ---------------------------------------------------------------------------------------------

def best_fit_plainly(lengths, permitted, overhead):
    """Totals of the bins as (capacity, used): every bin is looked at for every piece."""
    left, bins = sorted(lengths, reverse=True), []
    for k, n in enumerate(left):
        fits = [b for b in bins if b["room"] >= n]
        if fits:
            b = min(fits, key=lambda b: (b["room"], -b["turn"]))
        else:
            costs = [((c + overhead) / min(c, n + sum(x for x in left[k + 1:] if x <= c - n)), c) for c in permitted if c >= n]
            c = min(costs, key=lambda x: x[0])[1]
            b = {"room": c, "used": 0}
            bins.append(b)
        b["room"], b["used"], b["turn"] = b["room"] - n, b["used"] + n, k
    return sorted((min(c for c in permitted if c >= b["used"]), b["used"]) for b in bins)


def least_cost(lengths, permitted, overhead):
    """The optimum over all ways to divide the pieces."""
    best = [float("inf")]

    def put(i, sums):
        if i == len(lengths):
            best[0] = min(best[0], sum(min(c for c in permitted if c >= s) + overhead for s in sums))
            return
        for k in range(len(sums)):
            if sums[k] + lengths[i] <= permitted[-1]:
                put(i + 1, [*sums[:k], sums[k] + lengths[i], *sums[k + 1:]])
        put(i + 1, [*sums, lengths[i]])

    put(0, [])
    return best[0]


def test_packing_against_plain_best_fit_and_the_optimum():
    rng = np.random.default_rng(11)
    permitted, overhead = (16, 32, 64), 2
    for size in (0, 1, 2, 5, 7, 40, 300):
        for _ in range(25 if size < 40 else 5):
            lengths = rng.integers(1, 65, size).tolist()
            bins = defaultdict(list)
            for n, (b, c, o) in zip(lengths, packing.pack(lengths, permitted, overhead), strict=True):
                bins[b].append((o, n, c))
            got = []
            for pieces in bins.values():
                at = 0
                for o, n, _ in sorted(pieces):
                    assert o == at
                    at += n
                got.append((pieces[0][2], at))
            assert sorted(got) == best_fit_plainly(lengths, permitted, overhead)
            if size <= 7:
                cost = sum(c + overhead for c, _ in got)
                assert least_cost(lengths, permitted, overhead) <= cost <= 1.5 * least_cost(lengths, permitted, overhead) + overhead


# --- packing --------------------------------------------------------------------------------------------------------------

def test_pack_is_best_fit():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 8193, 3000).tolist()
    placed = packing.pack(lengths)
    used, spans = Counter(), defaultdict(list)
    for n, (b, capacity, offset) in zip(lengths, placed):
        used[b] += n
        spans[b].append((offset, offset + n, capacity))
    for b, s in spans.items():
        s.sort()
        assert s[0][0] == 0 and all(x[1] == y[0] for x, y in zip(s, s[1:])) and len({c for _, _, c in s}) == 1
        assert s[0][2] == min(c for c in packing.LENGTHS if c >= used[b])
    assert sum(lengths) / sum(s[0][2] for s in spans.values()) > 0.985
    # a few short pieces don't open a long bin
    assert {c for _, c, _ in packing.pack([100, 200])} == {1024} and packing.pack([]) == []


def test_pack_documents(odd, empty):
    got = packing.pack_documents(odd, group=4).collect()
    size = Counter()
    for r in odd.collect():
        size[r.doc_id] += len((r.text or "").encode())
    found = Counter()
    for r in got:
        found[r.doc_id] += r.length
        assert (r.bin is None) == (r.length == 0) and (r.bin is None or r.offset + r.length <= r.capacity)
    assert +found == +size and {r.doc_id for r in got} == {r.doc_id for r in odd.collect()}
    bins = defaultdict(list)
    for r in got:
        if r.bin is not None:
            bins[r.bin].append((r.offset, r.length))
    assert all(sum(n for _, n in b) == max(o + n for o, n in b) for b in bins.values())
    assert packing.pack_documents(empty).count() == 0


# --- components and near-duplicates ---------------------------------------------------------------------------------------

def groups_of(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 200)] + [(7, 7)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    nodes = {x for link in links if link[0] != link[1] for x in link}
    assert got == groups_of(nodes, [x for x in links if x[0] != x[1]])
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("distance, segments", [(3, 4), (2, 4), (7, 8), (3, 8)])
def test_ring_finds_every_link(spark, distance, segments):
    rng = np.random.default_rng(distance)
    codes = {int(x) for x in rng.integers(-2**63, 2**63, 60)} | {0, -1, 1, -2**63}
    for c in list(codes):
        for _ in range(4):
            for bit in rng.choice(64, rng.integers(1, distance + 3), replace=False):
                c ^= int(np.array(1 << int(bit), np.uint64).view(np.int64))
            codes.add(c)
    codes = sorted(codes)
    array = np.array(codes, np.int64).view(np.uint64)
    want = {(codes[i], codes[j]) for i in range(len(codes)) for j in range(i) if np.bitwise_count(array[i] ^ array[j]) <= distance}
    rows = simhash.Ring(distance, segments).links(spark.createDataFrame([(c,) for c in codes], "fp bigint")).collect()
    assert {(max(r.a, r.b), min(r.a, r.b)) for r in rows} == want and len(rows) == len(want)


def plain_fingerprint(text, words=3):
    xxhash = pytest.importorskip("xxhash")
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i:i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if shingles and 2 * counts[b] > len(shingles))


def test_simhash_groups(odd, empty):
    got = simhash.simhash_groups(odd).collect()
    rows = odd.collect()
    assert len(got) == len(rows) and simhash.simhash_groups(empty).count() == 0
    fps = {plain_fingerprint(r.text) for r in rows}
    assert {int(r.fingerprint, 16) for r in got} == fps
    group = groups_of(fps, [(a, b) for a in fps for b in fps if (a ^ b).bit_count() <= 3])
    least = {}
    for r in got:
        if r.doc_id is not None:
            g = group[int(r.fingerprint, 16)]
            least[g] = min(r.doc_id, least.get(g, r.doc_id))
    assert all(r.component_id == least.get(group[int(r.fingerprint, 16)]) for r in got)


def test_near_duplicates(spark, odd, empty):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    docs = []
    for i in range(60):
        text = list(rng.choice(vocabulary, rng.integers(60, 500)))
        docs.append(text)
        for _ in range(int(rng.integers(0, 4))):
            copy = list(text)
            for at in rng.choice(len(copy), max(1, int(len(copy) * rng.choice([0.005, 0.015, 0.2]))), replace=False):
                copy[at] = str(rng.choice(vocabulary))
            docs.append(copy)
    docs += [docs[0]] * 3
    docs = [docs[i] for i in rng.permutation(len(docs))]  # the least id of a group is any copy, also a far one
    rows = [(i, " ".join(t)) for i, t in enumerate(docs)]
    sets = [{" ".join(t[i:i + 5]) for i in range(len(t) - 4)} for t in docs]
    score = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(len(docs)) for j in range(i)}
    sure = groups_of(range(len(docs)), [k for k, v in score.items() if v >= 0.85])
    got = {r.doc_id: r.group for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[i] == got[sure[i]] for i in got)
    may = groups_of(range(len(docs)), [k for k, v in score.items() if v >= 0.75])
    assert all(may[i] == may[got[i]] for i in got)
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = sorted(r.doc_id for r in kept.where("doc_id is not null").collect())
    # 2 is a near copy of 1 and 6 of 5; 4 and 7 have no words, like 3
    assert ids == [-3, 1, 3, 5, 8, 9, 10, 11, 12]
    assert simhash.drop_near_duplicates(empty).count() == 0


def test_near_duplicates_with_repeated_passages(spark):
    """Copies in which a passage inside a line is repeated have nearly the same sets of shingles, but other counts of them."""
    rng = np.random.default_rng(8)
    docs, vocabulary = [], [f"w{i}" for i in range(4000)]
    for i in range(40):
        text = [str(x) for x in rng.choice(vocabulary, 200)]
        docs += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(text + text[-12:] * 20))]
    got = {r.doc_id: r.group for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(80)}


def test_near_duplicates_are_decided_on_whole_sets(spark):
    """Long texts whose similarity is close to 0.8, on either side."""
    rng = np.random.default_rng(4)
    docs = []
    for i in range(60):
        text = [f"a{x}" for x in rng.integers(0, 10**6, 1000)]
        docs += [(2 * i, text), (2 * i + 1, text[:-(98 + i // 3)] + [f"b{x}" for x in rng.integers(0, 10**6, 98 + i // 3)])]
    sets = [{" ".join(t[k:k + 5]) for k in range(len(t) - 4)} for _, t in docs]
    near = [i for i in range(0, 120, 2) if len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) >= 0.8]
    assert 20 < len(near) < 40
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_id bigint, text string")
    got = {r.doc_id: r.group for r in simhash.near_duplicates(rows).collect()}
    assert got == {i: i - i % 2 if i - i % 2 in near else i for i in range(120)}


def test_near_duplicates_by_the_ring(spark):
    """Without bands of minimum hashes the fingerprints alone find pairs; the whole sets still decide them."""
    rng = np.random.default_rng(12)
    docs = []
    for i in range(40):
        text = [f"a{x}" for x in rng.integers(0, 10**6, 400)]
        docs += [(2 * i, text), (2 * i + 1, text[:-1 - i // 10] + [f"b{x}" for x in range(1 + i // 10)])]
    # every shingle of a text occurs again and again: equal fingerprints, but a third of the set is other
    text = [f"c{x}" for x in range(30)]
    docs += [(80, text * 300), (81, text * 300 + [f"d{x}" for x in range(15)])]
    rows = [(i, " ".join(t)) for i, t in docs]
    prints = {i: simhash.simhash(simhash.shingle_hashes(t, 5)) for i, t in rows}
    sets = {i: set(simhash.shingle_set(t, 5).tolist()) for i, t in rows}
    near = {i for i in range(0, 82, 2) if ((prints[i] ^ prints[i + 1]) & (2**64 - 1)).bit_count() <= 3}
    linked = {i for i in near if len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) >= 0.8}
    assert len(linked) > 10 and near - linked == {80}
    got = {r.doc_id: r.group for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), bands=0).collect()}
    assert got == {i: i - i % 2 if i - i % 2 in linked else i for i, _ in rows}


# --- codes ----------------------------------------------------------------------------------------------------------------

def nearest(codes, queries, k):
    out = []
    for q, qc in queries:
        best = sorted(((qc ^ c) & (2**64 - 1)).bit_count() * 10**9 + i for i, c in codes if i != q)[:k]
        out += [(q, x % 10**9, x // 10**9, r + 1) for r, x in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("cost", [0, 10**9])
def test_nearest_codes(spark, monkeypatch, cost):
    monkeypatch.setattr(hamming, "LOOKUP_COST", cost)
    monkeypatch.setattr(hamming, "comb", lambda n, r: __import__("math").comb(n, r) if r < 3 else 10**12)
    rng = np.random.default_rng(9)
    centres = rng.integers(-2**63, 2**63, 12)
    codes = []
    for i in range(400):
        c = int(centres[i % 12])
        for bit in rng.choice(64, rng.integers(0, 9), replace=False):
            c ^= int(np.array(1 << int(bit), np.uint64).view(np.int64))
        codes.append((i, c))
    codes += [(1000 + i, int(centres[0])) for i in range(150)]  # one code for a third of the rows
    df = spark.createDataFrame([*codes, (None, 5), (3000, None)], "id bigint, code bigint")
    got = hamming.nearest_codes(df, df.where("id % 50 = 0"), k=10).collect()
    want = nearest(codes, [x for x in codes if x[0] % 50 == 0], 10)
    assert sorted((r.query_id, r.neighbour_id, r.distance, r.rank) for r in got) == want
    assert hamming.nearest_codes(df.limit(0), df.limit(0)).count() == 0
    few = spark.createDataFrame([(1, 5), (2, 7)], "id bigint, code bigint")
    assert [tuple(r) for r in hamming.nearest_codes(few, few.where("id = 1")).collect()] == [(1, 2, 1, 1)]


@pytest.mark.parametrize("n", [0, 1, 7, 500, 4000])
@pytest.mark.parametrize("covered", [-1, 11])
def test_block_index(n, covered):
    """Far apart codes, and a third of all with one value in 48 of their bits; k beyond the number of codes meets all of them."""
    rng = np.random.default_rng(n)
    codes = np.unique(np.where(rng.random(n) < 1 / 3, rng.integers(0, 2**16, n), rng.integers(-2**63, 2**63, n)))
    queries = np.concatenate([codes[:20], rng.integers(-2**63, 2**63, 20)])
    index = hamming.BlockIndex(codes)
    for k in (1, 11, 5000):
        query, code, distance = index.nearest(queries, k, covered)
        got = list(zip(query.tolist(), distance.tolist(), code.tolist(), strict=True))
        want = []
        for i, q in enumerate(queries):
            d = np.bitwise_count((codes ^ q).view(np.uint64)).astype(int)
            want += [(i, int(d[j]), int(j)) for j in np.argsort(d, kind="stable") if d[j] > covered][:k] if k > n else sorted((i, int(d[j]), int(j)) for j in range(len(codes)) if d[j] > covered)[:k]
        assert got == want


def test_lookups_of_the_shared_index_are_not_broadcast(spark, monkeypatch):
    """The planner sees as many lookups as queries; at 600,000 codes they were over 8 million and didn't fit the driver."""
    plans, stage = [], hamming.stage
    monkeypatch.setattr(hamming, "stage", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or stage(df, name))
    rng = np.random.default_rng(4)
    codes = list(enumerate(rng.integers(-2**63, 2**63, 300).tolist()))
    df = spark.createDataFrame(codes, "id bigint, code bigint")
    got = hamming.nearest_codes(df, df.where("id % 50 = 0"), k=10).collect()
    assert sorted((r.query_id, r.neighbour_id, r.distance, r.rank) for r in got) == nearest(codes, [x for x in codes if x[0] % 50 == 0], 10)
    lookups = [p for name, p in plans if name == "verified"]
    assert lookups and not any("Broadcast" in p for p in lookups)


@pytest.mark.parametrize("cost", [0.5, 10**9])
def test_nearest_codes_over_many_blocks(spark, monkeypatch, cost):
    """Some twenty blocks in three waves, small pieces inside a task, ties at the cut, and clusters with more copies than neighbours asked."""
    for name, value in (("LOOKUP_COST", cost), ("CODE_BLOCK", 64), ("QUERY_BLOCK", 8), ("TOGETHER", 3), ("LOOKUPS", 16), ("PAIRS", 32)):
        monkeypatch.setattr(hamming, name, value)
    rng = np.random.default_rng(12)
    codes = rng.integers(-2**63, 2**63, 1400)
    codes[300:500] = codes[:200] ^ (1 << rng.integers(0, 63, 200))
    codes[500:560], codes[560:900] = codes[3], (codes[7] & ~0xFFF) | rng.integers(0, 2**12, 340)
    rows = list(enumerate(codes.tolist()))
    df = spark.createDataFrame(rows, "id bigint, code bigint")
    got = hamming.nearest_codes(df, df.where("id % 50 = 0"), k=10).collect()
    assert sorted((r.query_id, r.neighbour_id, r.distance, r.rank) for r in got) == nearest(rows, [x for x in rows if x[0] % 50 == 0], 10)


def test_block_index_leaves_out_what_is_too_far():
    rng = np.random.default_rng(2)
    codes = np.unique(rng.integers(-2**63, 2**63, 3000))
    queries, most = codes[:60] ^ 5, np.arange(60) % 65
    query, code, distance = hamming.BlockIndex(codes).nearest(queries, 11, 3, most)
    got = list(zip(query.tolist(), distance.tolist(), code.tolist(), strict=True))
    apart = np.bitwise_count((codes ^ queries[:, None]).view(np.uint64)).astype(int)
    assert got == [(i, *x) for i in range(60) for x in sorted((int(apart[i, j]), int(j)) for j in np.flatnonzero((apart[i] > 3) & (apart[i] <= most[i])))[:11]]


def test_codes_of_long_vectors_are_refused(spark):
    df = spark.createDataFrame([(1, [0.5] * 65)], "vec_id bigint, embedding array<float>")
    with pytest.raises(Exception, match="at most 64"):
        hamming.sign_codes(df).collect()


def test_nearest_codes_ignores_other_columns(spark):
    rows = [(i, i, "x", i, 0, 1.5) for i in range(30)]
    df = spark.createDataFrame(rows, "id bigint, code bigint, qid string, s bigint, distance int, ids double")
    got = hamming.nearest_codes(df, df.where("id % 10 = 0"), k=3).collect()
    assert sorted((r.query_id, r.neighbour_id, r.distance, r.rank) for r in got) == nearest([x[:2] for x in rows], [x[:2] for x in rows if x[0] % 10 == 0], 3)


def test_sign_codes(spark):
    v = [0.5 if i in (0, 5, 63) else -0.1 for i in range(64)]
    row = hamming.sign_codes(spark.createDataFrame([(1, v, "x"), (2, None, "y"), (3, [1.0], "z")], "vec_id bigint, embedding array<float>, code string"))
    assert {r.id: r.code & (2**64 - 1) for r in row.collect()} == {1: 1 | 1 << 5 | 1 << 63, 3: 1}
    assert row.where(F.col("id") == 2).count() == 0
