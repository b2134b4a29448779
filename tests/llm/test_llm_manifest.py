"""Merkle manifest, WARC archives and hard negatives against brute force on awkward tables."""
import base64
import gzip
import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadframe.llm import merkle, negatives, warc
from leadframe.llm.common import Scratch


# ---- Merkle manifest

def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def parents(level):
    return [h("".join(level[i:i + 2])) for i in range(0, len(level), 2)]


def path_of(level, i):
    """(sibling, is it on the left) level by level, None where a node is alone."""
    out = []
    while len(level) > 1:
        j = i ^ 1
        out.append((level[j] if j < len(level) else None, j < i))
        level, i = parents(level), i // 2
    return out, level[0]


def brute_manifest(rows, claim):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees, subroots = {}, []
    for g in names:
        trees[g] = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        subroots.append(path_of([leaf_of(r) for r in trees[g]], 0)[1])
    out = []
    for k, g in enumerate(names):
        leaves = [leaf_of(r) for r in trees[g]]
        for i, r in enumerate(trees[g]):
            low, sub = path_of(leaves, i)
            top, root = path_of(subroots, k)
            folded = leaf_of(claim(r))
            for sib, left in low + top:
                folded = h((sib or "") + folded if left else folded + (sib or ""))
            proof = h("".join(s for s, _ in low + top if s))
            out.append((r[0], leaves[i], sub, root, proof, folded, folded == root))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos long, n int, hash string, key int"


def manifest_rows():
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["a", None, "ü"]), rnd.choice(["en", "en", "en", "de", None, ""]), rnd.choice([None, i]),
             rnd.choice([None, "", "text %d" % i, "Straße 漢字"])) for i in range(300)]
    rows += [(7, "a", "en", 5, "repeated")] * 100           # one row a third of the table
    rows += [(8, "a", "en", 5, f"shared id {i}") for i in range(40)]
    rows += [(None, None, None, None, None)] * 3 + [(None, "a", "xx", None, "x" * 50_000), (5, "a", "only", (1 << 63) - 1, "one leaf")]
    return rows


def tampered(r):
    return r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0


def op12(spark, rows, span):
    df = spark.createDataFrame([(*r, "x", 1, 2, "y", 3) for r in rows], SCHEMA).repartition(3)
    c = [F.col(x) for x in ("doc_id", "source", "lang", "n_chars", "text")]
    leaf = merkle.leaf_hash(*c)
    changed = merkle.leaf_hash(*c[:3], c[3].cast("decimal(20,0)") + 1, c[4])
    claim = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, changed).otherwise(leaf)
    out = merkle.climb(merkle.build(df, leaf, "lang", "doc_id", claim, span=span))
    return sorted([(r.key, r.leaf, r.subroot, r.root, h(bytes(r.proof).hex()), r.folded, r.verified) for r in out.collect()], key=str)


@pytest.mark.parametrize("span", [1, 3, 8])
def test_manifest_equals_brute_force(spark, span):
    rows = manifest_rows()
    want = brute_manifest(rows, lambda r: (*r[:3], r[3] + 1, r[4]) if tampered(r) and r[3] is not None else r)
    got = op12(spark, rows, span)
    assert got == want
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_manifest_of_one_row_and_of_none(spark):
    row = (3, "a", "en", 1, "t")
    leaf = leaf_of(row)
    assert op12(spark, [row], 8) == [(3, leaf, leaf, leaf, h(""), leaf, True)]
    assert op12(spark, [], 8) == []


def test_leaf_places_are_dealt_over_ranges(spark):
    df = spark.createDataFrame([(7, "a", "en", 5, "same")] * 4000, "doc_id long, source string, lang string, n_chars long, text string")
    rows = merkle.places(df.select("lang", "doc_id"), "lang", ["doc_id"], Scratch(spark, "t"), "ranges")
    assert sorted(r.pos for r in rows.select("pos").collect()) == list(range(4000))


# ---- WARC

PAGES = "page_id long, url string, html string, digest string, row long, response int, payload string, bytes long"


def pages():
    rnd = random.Random(4)
    texts = [None, "", "<p>one</p>", "a\r\n\r\nb", "WARC/1.1\r\n\r\n", "Straße 漢字 \x00", "x" * 300_000] + [f"<p>{rnd.random()}</p>" for _ in range(60)]
    rows = [(i, rnd.choice([None, "", f"http://e.com/{i}", "http://e.com/a\r\nb: c%0A"]), rnd.choice(texts)) for i in range(250)]
    rows += [(9, "http://e.com/hot", "hot")] * 120 + [(9, "http://e.com/other", "hot"), (9, None, "own")]
    rows += [(None, None, "no id"), (None, "u", "no id"), (None, "u", "hot")]
    return rows


def brute_warc(rows):
    groups = {}
    for r in rows:
        groups.setdefault((r[2] or "").encode(), []).append(r[0])
    out = []
    for payload, ids in groups.items():
        ids.sort(key=lambda i: -1 if i is None else i, reverse=True)
        dig = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out += [(i, len(payload), dig, "revisit" if k else "response", ids[0] if k else None) for k, i in enumerate(ids)]
    return sorted(out, key=str)


def written(spark, rows, **options):
    s = Scratch(spark, "warc")
    df = spark.createDataFrame([(*r, "x", 1, 0, "y", 2) for r in rows], PAGES).repartition(4)
    path = f"{s.root}/archives"
    return warc.write_archives(df, path, s, **options), path


def as_rows(records):
    return sorted([(None if r.id is None else int(r.id), r.payload_bytes, r.payload_digest, r.record_type,
                    None if r.refers_to_id is None else int(r.refers_to_id)) for r in records.collect()], key=str)


@pytest.mark.parametrize("archive_bytes", [1 << 30, 2000])
def test_archives_equal_brute_force(spark, archive_bytes):
    index, path = written(spark, pages(), archive_bytes=archive_bytes)
    assert as_rows(warc.read_records(index, path)) == brute_warc(pages())
    assert as_rows(warc.read_records(index, path, max_gap=0, max_read=1000)) == brute_warc(pages())


def test_payloads_and_urls_come_back(spark):
    index, path = written(spark, pages())
    got = warc.read_records(index, path).collect()
    by_digest = {r.payload_digest: bytes(r.payload).decode() for r in got if r.record_type == "response"}
    assert set(by_digest.values()) == {p[2] or "" for p in pages()}
    want = sorted(((p[0], p[1], warc.base32_digest((p[2] or "").encode())) for p in pages()), key=str)
    assert sorted(((None if r.id is None else int(r.id), r.url, r.payload_digest) for r in got), key=str) == want
    ids = {r.record_id for r in got if r.record_type == "response"}
    assert len({r.record_id for r in got}) == len(got)
    assert all(r.refers_to_record in ids for r in got if r.record_type == "revisit")


def test_selected_records_are_read_by_coalesced_ranges(spark):
    index, path = written(spark, pages())
    chosen = index.filter("record_type = 'response' AND url LIKE 'http://e.com/1%'")
    got = warc.read_records(chosen, path)
    assert sorted(r.record_id for r in got.collect()) == sorted(r.record_id for r in chosen.collect())
    near, apart = warc.byte_ranges(index, 1 << 30, 1 << 30), warc.byte_ranges(index, -1, 1 << 30)
    assert near.count() == index.select("archive").distinct().count() and apart.count() == index.count()
    assert all(r.stop - r.start <= 5000 + max(x.length for x in r.records) for r in warc.byte_ranges(index, 1 << 30, 5000).collect())


def test_archives_are_plain_warc(spark):
    index, path = written(spark, pages())
    _, folder = warc.file_system(path)
    for name in {r.archive for r in index.collect()}:
        with gzip.open(os.path.join(folder, name)) as f:
            assert f.read(8) == b"WARC/1.1"
    r = index.filter("record_type = 'revisit'").first()
    with open(os.path.join(folder, r.archive), "rb") as f:
        f.seek(r.offset)
        headers, block = warc.parse_record(gzip.decompress(f.read(r.length)))
    assert headers["warc-profile"] == warc.PROFILE and block.endswith(b"\r\n\r\n")


def test_a_changed_payload_is_an_error(spark):
    index, path = written(spark, [(1, "u", "payload")])
    r = index.first()
    _, folder = warc.file_system(path)
    file = os.path.join(folder, r.archive)
    data = open(file, "rb").read()
    record = gzip.decompress(data[r.offset:]).replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n")
    with open(file, "wb") as f:
        f.write(data[:r.offset] + gzip.compress(record))
    size = os.path.getsize(file) - r.offset
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_records(index.withColumn("length", F.lit(size).cast("long")), path).collect()


def test_no_pages(spark):
    index, path = written(spark, [])
    assert index.count() == 0 and warc.read_records(index, path).count() == 0


# ---- Hard negatives

@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 2), (1, 4)])
def test_hilbert_visits_neighbours(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
    place = negatives.hilbert(cells, bits)
    assert sorted(place) == list(range(len(cells)))
    steps = np.abs(np.diff(cells[np.argsort(place)], axis=0))
    assert (steps.sum(1) == 1).all()


VECTORS = "vec_id long, embedding array<float>, label int, id long, v string, h long, part int, block int, salt int, slot int"


def brute_negatives(rows, n_pos=5, n_neg=3):
    part = [(i, np.array([int(np.floor(min(max(float(x) * 256, -2**26), 2**26))) for x in v], object), la) for i, v, la in rows
            if i is not None and la is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dims = max((len(v) for _, v, _ in part), default=0)
    part = [(i, np.concatenate([v, np.zeros(dims - len(v), int)]), la) for i, v, la in part]
    out = []
    for k, (i, v, la) in enumerate(part):
        if i % 50:
            continue
        scored = sorted([(-int((v * w).sum()), j, lb == la) for m, (j, w, lb) in enumerate(part) if m != k], key=lambda t: t[:2])
        for s, j, _ in [t for t in scored if t[2]][:n_pos]:
            hits = [t for t in scored if not t[2] and 50 * -s <= 100 * -t[0] <= 95 * -s][:n_neg]
            out += [(i, j, r + 1, t[1], -s, -t[0]) for r, t in enumerate(hits)]
    return sorted(out)


def vectors(n, dims, seed=6):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(5, dims))
    return [(i, [float(np.float32(x)) for x in (centres[i % 5] + rnd.normal(size=dims)) / 4], int(rnd.integers(3))) for i in range(n)]


def mined(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x", 2, 3, 4, 5, 6) for r in rows], VECTORS).repartition(3)
    return sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 50 == 0, **options).collect())


def test_negatives_equal_brute_force(spark):
    rows = vectors(1500, 8)
    rows += [(2000 + i, rows[50][1], 1) for i in range(700)]               # one vector that a third of the rows share
    rows += [(100, rows[0][1], 2), (100, rows[0][1], 2), (100, rows[3][1], 1)]      # repeated ids and rows
    rows += [(None, rows[0][1], 1), (3001, None, 1), (3002, rows[0][1], None), (3003, [1.0, None] + rows[0][1][2:], 1),
             (3050, [float("nan")] * 8, 1), (3100, [float("inf")] * 8, 1), (3150, [], 1), (3200, [1.0, 2.0], 0),
             (3250, [1e30] * 8, 0), (3251, [-1e30] * 8, 1), (3300, [0.0] * 8, 1), (-50, rows[9][1], 2)]
    got = mined(spark, rows)
    assert got == brute_negatives(rows)
    assert len(got) > 100


def test_negatives_by_small_batches_and_of_many_labels(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BATCH_CELLS", 64)
    rows = [(i, v, i % 40) for i, v, _ in vectors(700, 6, 7)]
    assert mined(spark, rows, n_positives=2, n_negatives=4) == brute_negatives(rows, 2, 4)


def test_zone_maps_skip_blocks(spark):
    """Two far clusters: an anchor's windows need no block of the other one."""
    rnd = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rnd.normal(size=4) / 50 + ([3, 0, 0, 0] if i % 2 else [-3, 0, 0, 0])], i % 3) for i in range(8000)]
    df = spark.createDataFrame([(*r, 1, "x", 2, 3, 4, 5, 6) for r in rows], VECTORS)
    b = negatives.write_blocks(negatives.quantised(df, "vec_id", "embedding", "label", F.lit(False)), Scratch(spark, "t"))
    zones = b.table.collect()
    assert sum(len(z.ids) // 8 for z in zones) == 8000
    v = np.array([[768, 0, 0, 0]])
    batch = negatives.Batch(v, np.array([1]), np.array([0]), np.zeros((1, 3), int), np.array([[400_000]]), np.array([[700_000]]))
    need = negatives._needed(batch, np.array([z.low for z in zones]), np.array([z.high for z in zones]), [z.labels_in for z in zones], False)
    right = np.array([z.high[0] > 0 for z in zones])
    assert (need[0] <= right).all() and 0 < need.sum() < len(zones)


def test_no_vectors(spark):
    assert mined(spark, []) == [] and mined(spark, [(50, None, 1)]) == [] and mined(spark, [(50, [1.0], 1)]) == []
    assert mined(spark, [(50, [], 1), (51, [], 1), (52, [], 2)]) == [(50, 51, 1, 52, 0, 0)]
