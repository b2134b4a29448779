"""The pipeline's decisions, stage by stage, against brute force on its own input."""
import hashlib
import re
import subprocess
import sys

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken
from llm_fixtures import rows_of
from test_llm_dedup import brute_components, squeeze
from test_llm_native import brute_targets

from leadframe.llm import bpe, quality
from leadframe.llm.common import Scratch

SF = "/root/testdata/sf0.01"
COLS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark):
    """documents, then what each stage returns, each written and read again."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    s, out = Scratch(spark, "test-pipeline"), [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(s.put(stage(spark, out[-1], SF), f"stage{i}"))
    return out


def test_stages_keep_the_columns(tables):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact dedup", "near dedup", "mixing", "byte bpe"]
    assert all(t.columns == COLS for t in tables[:-1])


def test_quality_stage_drops_junk_and_keeps_clean(spark, tables):
    kept = {i for i, in rows_of(tables[1], "doc_id")}
    labels = rows_of(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "quality")
    clean, junk = [i for i, q in labels if q == 1], [i for i, q in labels if q == 0]
    assert sum(i in kept for i in clean) >= 0.99 * len(clean)
    assert sum(i not in kept for i in junk) >= 0.95 * len(junk)
    assert set(rows_of(tables[1], *COLS)) <= set(rows_of(tables[0], *COLS))


def test_exact_dedup_stage(tables):
    best = {}
    for r in rows_of(tables[1], *COLS):
        key = squeeze(r[1])
        if key not in best or (-len(r[1] or ""), r[0]) < (-len(best[key][1] or ""), best[key][0]):
            best[key] = r
    assert sorted(rows_of(tables[2], *COLS)) == sorted(best.values())


def test_near_dedup_stage(tables):
    rows = rows_of(tables[2], *COLS)
    keep = {i for i, _, c in brute_components(rows) if i == c}
    assert sorted(rows_of(tables[3], *COLS)) == sorted(r for r in rows if r[0] in keep)
    assert len(keep) < len(rows)


def test_near_dedup_stage_goes_by_row_not_by_id(spark):
    """Texts under one id, near copies under null ids and under the smallest id, rows without words."""
    def near(seed, *edits):
        words = ["%s%d" % (seed, i) for i in range(80)]
        for i in edits:
            words[i] = "edit%d" % i
        return " ".join(words)
    rows = [(3, near("a")), (5, near("a", 79)), (5, near("b")), (5, None), (5, ""),
            (None, near("c")), (None, near("c", 0)), (None, near("a", 0)), (None, None), (None, near("d")),
            (1, near("e")), (1, near("e", 79)), (2, near("e", 0)), (1, near("f"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = corpus_pipeline.near_dedup_stage(spark, docs, SF)
    assert got.columns == docs.columns
    want = [(3, near("a")), (5, near("b")), (5, None), (5, ""), (None, near("c")), (None, None), (None, near("d")),
            (1, near("e")), (1, near("f"))]
    assert sorted(rows_of(got, "doc_id", "text"), key=str) == sorted(want, key=str)


def test_mixing_stage_meets_targets(tables):
    def words(t):
        return len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    sizes, taken, largest = {}, {}, {}
    for _, t, _, s, _ in rows_of(tables[3], *COLS):
        sizes[s] = sizes.get(s, 0) + words(t)
        largest[s] = max(largest.get(s, 0), words(t))
    times = {}
    for r in rows_of(tables[4], *COLS):
        taken[r[3]] = taken.get(r[3], 0) + words(r[1])
        times[r] = times.get(r, 0) + 1
    assert max(times.values()) <= 3 and set(times) <= set(rows_of(tables[3], *COLS))
    for s, want in brute_targets(sizes).items():
        assert abs(taken[s] - want) <= largest[s] / 2 + 1


def test_encode_stage(tables):
    ranks = bpe.Vocabulary(bpe.read_ranks(public_tokenizers.path(corpus_pipeline.VOCABULARY))).ranks
    tik = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((i, len(tik.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest())
                  for i, t in rows_of(tables[4], "doc_id", "text"))
    assert sorted(rows_of(tables[5], "doc_id", "n_tokens", "decoded_sha256")) == want


def test_awkward_rows_pass_through(spark):
    """Nulls, empty and repeated rows, extra columns with clashing names, an empty table."""
    docs = spark.createDataFrame(
        [(1, None, None, None, 0, 5, "x"), (2, "", "en", "a", 0, 5, "x"), (None, "no id here at all today", "en", "a", 3, 5, "x"),
         (3, "one two three four five six", "en", "a", 3, 5, "x"), (3, "one two three four five six", "en", "a", 3, 5, "x"),
         (4, "w " * 20000, "en", None, 3, 5, "x")],
        "doc_id long, text string, lang string, source string, n_chars long, size long, kept string")
    for start in (docs, docs.limit(0)):
        s, d = Scratch(spark, "test-odd"), start
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, d, "/root/testdata/sf0.001")
            if i < 4:
                assert out.columns == docs.columns
            d = s.put(out, f"s{i}")
    assert d.count() == 0


def test_the_rest_works_without_this_subpackage(tmp_path):
    """__spark_entry__ imports, and offers the other queries, when llm and corpus_pipeline are gone."""
    code = ("import sys\n"
            "class Gone:\n"
            "    def find_spec(self, name, *a):\n"
            "        if name in ('corpus_pipeline', 'leadframe.llm'): raise ImportError(name)\n"
            "sys.meta_path.insert(0, Gone())\n"
            "import __spark_entry__ as e\n"
            "q, o = e.queries(), e.oracle_sql()\n"
            "assert 'k1_upsert_people' in q and 'pipeline' not in q and not any(x.startswith('op1') for x in q)\n"
            "assert set(o) <= set(q) and 'leadframe.llm' not in sys.modules\n")
    root = corpus_pipeline.__file__.rsplit("/", 1)[0]
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


def test_quality_threshold_is_the_contracts():
    assert quality.KEEP_AT == 0.3
