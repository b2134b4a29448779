"""Chat formatting, sharding, secret scan and mixing against brute force."""
import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from llm_fixtures import documents, empty, frame, rows_of
from pyspark.sql import functions as F

from leadframe.llm import chat, mixing, secrets, sharding
from leadframe.llm.common import Scratch


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ------------------------------------------------------------------ chat
CHAT = "conv_id long, turn long, role string, text string, id long, pos long, n long, a long, rendered string"


def chats(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, "x") for r in rows], CHAT).repartition(3)


def render(turns):
    return "".join(f"<|{'unknown' if r is None else r}|>\n{t or ''}<|end|>\n" for r, t in turns)


def brute_chats(rows):
    convs = {}
    for c, n, r, t in rows:
        convs.setdefault(c, []).append((n is None, n or 0, r, t))
    # texts of turns with one number: any order in the fixtures, which have none
    whole = {c: render([(r, t) for _, _, r, t in sorted(v, key=lambda x: x[:2])]) for c, v in convs.items()}
    steps = {c: len(v) for c, v in convs.items()}
    out = {}
    for c, s in whole.items():
        if not any(o != s and o.startswith(s) for o in whole.values()):
            out.setdefault(s, []).append(c)
    return sorted(((min(x for x in cs if x is not None) if any(x is not None for x in cs) else None),
                   steps[cs[0]], len(cs), s) for s, cs in out.items())


def test_chat_snapshots_collapse(spark):
    rnd = random.Random(3)
    rows, c = [], 0
    for _ in range(12):
        turns = [(rnd.choice(["user", "assistant", None]), rnd.choice(["hi", None, "", "long " * 50, "Ümlaut"]) if k else "hi")
                 for k in range(rnd.randint(1, 7))]
        for upto in {len(turns), rnd.randint(1, len(turns)), rnd.randint(1, len(turns))}:
            for _ in range(rnd.randint(1, 2)):
                rows += [(c, k * 2, r, t) for k, (r, t) in enumerate(turns[:upto])]
                c += 1
    got = chat.format_chats(chats(spark, rows))
    assert sorted(rows_of(got, "conv_id", "n_turns", "n_copies", "rendered")) == brute_chats(rows)
    no_python(got)


def test_chat_awkward_rows(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "user", "b"), (1, 0, "user", "a"), (2, None, "user", "last"),
            (2, 5, "user", "first"), (3, 0, "user", "same"), (3, 0, "user", "same")]
    got = rows_of(chat.format_chats(chats(spark, rows)), "conv_id", "n_turns", "n_copies", "rendered")
    assert sorted(got, key=str) == sorted([
        (None, 2, 1, render([("user", "a"), ("user", "b")])), (2, 2, 1, render([("user", "first"), ("user", "last")])),
        (3, 2, 1, render([("user", "same")] * 2))], key=str)
    assert chat.format_chats(spark.createDataFrame([], CHAT)).count() == 0


# ------------------------------------------------------------------ sharding
def test_shards_are_near_equal_and_gapless(spark):
    rows = documents() + [(1, "same", None, None)] * 50
    got = rows_of(sharding.shard_documents(frame(spark, rows), 5), "doc_id", "size", "text_crc32", "shard", "slot")
    assert sorted(r[:3] for r in got) == sorted(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    slots = {}
    for *_, shard, slot in got:
        slots.setdefault(shard, []).append(slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard_documents(empty(spark), 5).count() == 0


def test_slot_bytes_are_balanced():
    rnd = random.Random(1)
    size = {k: rnd.randint(1, 1000) for k in range(4096)}
    first = sharding.spread_slots(size, 4096, 24)
    load = Counter()
    for k, sh in first.items():
        load[sh] += size[k]
    assert max(load.values()) - min(load.values()) < 1000
    grown = sharding.grow_slots(first, size, 25)
    moved = [k for k in first if first[k] != grown[k]]
    load = Counter()
    for k, sh in grown.items():
        load[sh] += size[k]
    assert all(grown[k] == 24 for k in moved)       # one more shard takes slots only into itself
    assert sum(size[k] for k in moved) < 1.05 * sum(size.values()) / 25
    assert max(load.values()) < 1.03 * min(load.values())
    size = {k: b * (3 if k % 24 < 4 else 1) for k, b in size.items()}
    uneven = {k: k % 24 for k in size}
    even = sharding.rebalance_slots(uneven, size, 24)
    load = Counter()
    for k, sh in even.items():
        load[sh] += size[k]
    assert max(load.values()) - min(load.values()) <= 0.01 * sum(size.values()) / 24
    assert sum(even[k] != uneven[k] for k in size) < len(size) / 3


def test_slot_map_versions(spark):
    root = Scratch(spark, "test-map").root
    m = sharding.SlotMap(spark, root)
    assert m.versions() == [] and m.write({0: 1, 1: 0}) == 1 and m.write({0: 1, 1: 1}) == 2
    assert m.as_dict() == {0: 1, 1: 1} and m.as_dict(1) == {0: 1, 1: 0}
    spark.createDataFrame([(0, 9)], "vslot int, shard int").write.parquet(f"{root}/v=3")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/v=3/_SUCCESS")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)
    assert m.versions() == [1, 2] and m.as_dict() == {0: 1, 1: 1}       # a half-written version doesn't count
    docs = frame(spark, documents())
    assert {r[0] for r in rows_of(sharding.shard_documents(docs, 2, n_slots=2, slot_map=m), "shard")} == {1}


# ------------------------------------------------------------------ secrets
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_base(t):
    t = t or ""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 24]
    return sorted(out, key=lambda x: (x[1], secrets.KINDS.index(x[0])))


def test_secret_spans(spark):
    rnd = random.Random(8)
    bits = ["token", "TOKEN", "api_key", "ApiKey", "password", "secret", '"', "'", " ", "  ", ":", "=", "abc", "abcdef",
            "0123456789abcdef" * 2, "AKIA" + "Q7" * 8, "AKIA", "Z" * 16, "é漢", "😀", "\n", "ſecret=abcdefgh", "Xy9-Xy9_1234567890ABCDEF"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25))) for _ in range(300)]
    texts += [None, "", "secret=token : abcdefgh", "token: secret : abcdefgh", 'password = "hunter22" ' * 300]
    rows = [(i, t, None, "s%d" % (i % 7)) for i, t in enumerate(texts)]
    got = secrets.scan_secrets(frame(spark, rows))
    no_python(got)
    got = got.select("doc_id", secrets.span_text(F.col("base")).alias("b"))
    assert dict(rows_of(got, "doc_id", "b")) == {i: ",".join(f"{k}:{s}:{e}" for k, s, e in brute_base(t))
                                                 for i, t, *_ in rows}
    assert secrets.scan_secrets(empty(spark)).count() == 0


def test_secret_ownership(spark):
    live, copied = "Zk9-Live_1234567890abcdXY", "Zk9-Copy_1234567890abcdXY"
    rows = [(1, f"see {live}", "en", "a"), (2, f"{live} again", "de", "a"), (3, f"x {copied}", "en", "a"),
            (4, f"x {copied}", "en", None), (5, "api_key=shared99", "en", "a"), (6, "api_key=shared99", "en", "b"),
            (7, "a_long_word_without_any_digits", "en", "a"), (7, "token=" + live, "en", "a")]
    got = secrets.scan_secrets(frame(spark, rows)).select(
        "doc_id", secrets.span_text(F.concat("base", "added")).alias("s"), "n_live", "n_shared")
    n = len(live)
    assert sorted(rows_of(got, "doc_id", "s", "n_live", "n_shared")) == sorted([
        (1, f"owned:4:{4 + n}", 1, 0), (2, f"owned:0:{n}", 1, 0), (3, "", 0, 1), (4, "", 0, 1),
        (5, "assign:0:16", 0, 1), (6, "assign:0:16", 0, 1), (7, "", 0, 0), (7, f"assign:0:{6 + n}", 1, 0)])


# ------------------------------------------------------------------ mixing
def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    held, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in held)
        free = sum(w[s] for s in names if s not in held)
        share = {s: rest * w[s] / free for s in names if s not in held}
        over = {s for s, x in share.items() if x > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in held else share[s] for s in names}
        held |= over


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_meets_targets(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 30)) + rnd.choice(["", " ###", "\n\t"]), None,
             rnd.choice(["hot"] * 6 + ["b", "é", "Z", "", None, "small"])) for i in range(3000)]
    rows = [r for r in rows if r[3] != "small" or r[0] % 40 == 0] + [(9999, None, None, "nothing")]
    df = mixing.mix_sources(frame(spark, rows), carry=("source", "size"), prefix="m_")
    no_python(df)
    got = rows_of(df, "m_size", "m_source_size", "m_target", "m_taken", "m_times", "source")
    words = [(len(re.findall("[^\x20\x09-\x0d]+", t or "")), s) for _, t, _, s in rows]
    sizes = Counter()
    for n, s in words:
        sizes[s] += n
    assert Counter((r[0], r[5]) for r in got) == Counter(words)
    want, taken, largest = brute_targets(sizes), Counter(), Counter()
    for size, source_size, target, took, times, s in got:
        assert source_size == sizes[s] and target == pytest.approx(want[s]) and took == size * times <= 3 * size
        taken[s] += took
        largest[s] = max(largest[s], size)
        if sizes[s]:
            assert not size or times in (int(target // source_size), int(target // source_size) + 1)
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6 for s in sizes)


def test_mix_prefers_quality_and_repeats(spark):
    rows = [(i, "word " * 10 + ("#" * 60 if i % 2 else ""), None, "a") for i in range(2000)] + \
           [(i, "word " * 40, None, "b") for i in range(2000, 4000)]
    def run():
        return sorted(rows_of(mixing.mix_sources(frame(spark, rows), weights=(1, 12), max_epochs=2), "doc_id", "times"))
    got = run()
    assert got == run()
    plain, junk = (sum(t for i, t in got if i < 2000 and i % 2 == k) for k in (0, 1))
    assert plain > 2 * junk > 0


def test_mix_empty(spark):
    assert mixing.mix_sources(empty(spark)).count() == 0
    got = rows_of(mixing.mix_sources(frame(spark, [(1, None, None, None), (2, " ", None, "a")])), "size", "target", "taken")
    assert got == [(0, 0.0, 0)] * 2


def test_digest_form(spark):
    from leadframe.llm.queries import op5_scan_secrets
    sf = "/root/testdata/sf0.001"
    text = dict(rows_of(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text"))
    for i, h in rows_of(op5_scan_secrets(spark, sf), "doc_id", "base_sha256"):
        assert h == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in brute_base(text[i])).encode()).hexdigest()
