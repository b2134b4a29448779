"""The dealt operators' queries over the given tables, and their DuckDB oracles."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from leadframe.llm import bpe, chat, exact_dedup, jaccard, langid, merkle, mixing, negatives, quality, secrets, sharding, spotsigs, warc
from leadframe.llm.common import Scratch

QUERIES: dict = {}
ORACLES: dict = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


_OP1_SQL = """
WITH t AS (SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS pos,
    count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
p AS (SELECT conv_id, pos, n, string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '')
    OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM t)
SELECT min(conv_id) AS conv_id, n AS n_turns, count(*) AS n_copies, s AS rendered
FROM p WHERE pos = n AND NOT EXISTS (SELECT 1 FROM p q WHERE q.pos < q.n AND q.pos = p.n AND q.s = p.s)
GROUP BY n, s
"""


@register("op1_format_chats", _OP1_SQL)
def op1_format_chats(spark, sf):
    """Every maximal logged conversation, rendered."""
    return chat.format_chats(table(spark, sf, "conversations"))


VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@register("op2_byte_bpe")
def op2_byte_bpe(spark, sf):
    """Every text encoded, and decoded again from its ids."""
    ranks = bpe.read_ranks(public_tokenizers.path(VOCABULARY))
    both = bpe.encode(table(spark, sf, "documents"), ranks, with_offsets=False, decoded_col="decoded")
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@register("op3_shard_by_slots")
def op3_shard_by_slots(spark, sf):
    """All documents into 24 shards of near equal bytes, by virtual slots."""
    return sharding.shard_documents(table(spark, sf, "documents"), 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "vslot")


@register("op4_spotsigs")
def op4_spotsigs(spark, sf):
    """Fingerprints of all texts and of their edited texts, with the corpus's own anchors."""
    docs = table(spark, sf, "documents")
    return spotsigs.compare_with_next(docs, anchors=spotsigs.corpus_anchors(docs))


def crc_of_id(id_col):
    return F.crc32(id_col.cast("string").cast("binary"))


@register("op7_language")
def op7_language(spark, sf):
    """Language of every text, learnt where crc32(doc_id) mod 3 is not 1."""
    docs = table(spark, sf, "documents")
    held_out = crc_of_id(F.col("doc_id")) % 3 == 1
    model = langid.learn_languages(docs.filter(~held_out))
    return langid.predict_languages(docs.withColumn("held_out", held_out), model, carry=("doc_id", "held_out"))


@register("op8_quality")
def op8_quality(spark, sf):
    """Quality score of every text, learnt where crc32(doc_id) mod 5 is not 0."""
    docs = table(spark, sf, "documents")
    weights = quality.learn_quality(docs, table(spark, sf, "labels"), learn_from=lambda x: crc_of_id(x) % 5 != 0)
    out = quality.score_quality(docs.withColumn("held_out", crc_of_id(F.col("doc_id")) % 5 == 0), weights,
                                carry=("doc_id", "held_out"))
    return out.withColumn("predicted", (F.col("score") >= quality.KEEP_AT).cast("int"))


_OP9_SQL = """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS cp,
                  regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id,
  first_value(doc_id) OVER (PARTITION BY norm ORDER BY cp DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY norm) AS group_size,
  row_number() OVER (PARTITION BY norm ORDER BY cp DESC, doc_id) = 1 AS kept,
  sha256(norm) AS text_sha256
FROM d
"""


@register("op9_exact_dedup", _OP9_SQL)
def op9_exact_dedup(spark, sf):
    """Progressive refinement over all documents, with the digest of every text."""
    return exact_dedup.exact_dedup(table(spark, sf, "documents"), digest_all=True)


def _op5_hits(kind):
    pattern, group, least = secrets.PATTERNS[kind]
    p = pattern.replace("'", "''")
    more = ""
    if kind == "owned":
        more = (f" AND length(regexp_replace(v, '[^A-Za-z]', '', 'g')) >= {secrets.MIN_LETTERS}"
                f" AND length(regexp_replace(v, '[^0-9]', '', 'g')) >= {secrets.MIN_DIGITS}")
    return f"""
SELECT * FROM (
  SELECT doc_id, owner, repo, {secrets.KINDS.index(kind)} AS k, '{kind}' AS kind, v,
    (sum(length(part) + length(hit)) OVER w - length(hit))::BIGINT AS s, (sum(length(part) + length(hit)) OVER w)::BIGINT AS e
  FROM (SELECT doc_id, owner, repo, unnest(string_split_regex(t, '{p}')[:len(regexp_extract_all(t, '{p}'))]) AS part,
               unnest(regexp_extract_all(t, '{p}')) AS hit, unnest(regexp_extract_all(t, '{p}', {group})) AS v,
               generate_subscripts(regexp_extract_all(t, '{p}'), 1) AS i FROM d)
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE length(v) >= {least}{more}"""


_OP5_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce('=' || source, '') AS owner,
    coalesce('=' || source, '') || '/' || coalesce('=' || lang, '') AS repo FROM documents),
base AS ({" UNION ALL ".join(_op5_hits(k) for k in secrets.KINDS[:3])}),
own AS (SELECT * FROM ({_op5_hits("owned")}) o
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = o.doc_id AND b.s < o.e AND o.s < b.e)),
cand AS (SELECT * FROM base UNION ALL SELECT * FROM own),
freq AS (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT (owner, repo)) AS repos FROM cand GROUP BY v),
c AS (SELECT cand.*, owners, repos, owners <= {secrets.MAX_OWNERS} AND repos <= {secrets.MAX_REPOS} AS live, kind || ':' || s || ':' || e AS txt FROM cand JOIN freq USING (v)),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex, string_agg(txt, ',' ORDER BY s, k) FILTER (k < 3) AS base,
  string_agg(txt, ',' ORDER BY s, k) FILTER (k < 3 OR live) AS spans,
  count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_shared,
  max(owners) AS max_owners, max(repos) AS max_repos FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_shared, 0) AS n_shared,
  coalesce(max_owners, 0) AS max_owners, coalesce(max_repos, 0) AS max_repos FROM d LEFT JOIN a USING (doc_id)
"""


@register("op5_scan_secrets", _OP5_SQL)
def op5_scan_secrets(spark, sf):
    """Secrets of all documents; an owner is a source, a repository a source and language."""
    found = secrets.scan_secrets(table(spark, sf, "documents"))

    def n(kind):
        return F.size(F.filter("base", lambda b: b["kind"] == secrets.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", n("assign"), n("access"), n("hex"), F.sha2(secrets.span_text(F.col("base")), 256).alias("base_sha256"),
        secrets.span_text(F.concat("base", "added")).alias("spans"), "n_live", "n_shared", "max_owners", "max_repos")


_OP6_SQL = f"""
WITH d AS (SELECT doc_id, source IS NULL AS sn, coalesce(source, '') AS src,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    CASE WHEN length(coalesce(text, '')) > 0 THEN greatest(0.1, 1.0 - 4.0::DOUBLE * (length(text) -
      length(translate(text, '{mixing.JUNK}', '')))::DOUBLE / length(text)) ELSE 0.1 END::DOUBLE AS q,
    (('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '-') || ':' || md5(coalesce(text, '')) || ':' ||
      (row_number() OVER (PARTITION BY doc_id, coalesce(text, '') ORDER BY source NULLS LAST) - 1)), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(1 << 52)!r} AS u
  FROM documents),
k AS (SELECT *, -ln(u) / q AS key, (sum(size) OVER (PARTITION BY sn, src))::BIGINT AS source_size FROM d),
s AS (SELECT sn, src, any_value(source_size) AS source_size,
    [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY sn, src) - 1) % 3]::DOUBLE AS w FROM k GROUP BY sn, src),
t AS (SELECT *, (3 * source_size)::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE AS total,
    sum(w) OVER () AS all_w, coalesce(sum(3.0::DOUBLE * source_size) OVER o, 0) AS cb, coalesce(sum(w) OVER o, 0) AS wb
  FROM s WINDOW o AS (ORDER BY (3 * source_size)::DOUBLE / w, sn, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, cap / w <= (total - cb) / (all_w - wb) AS held FROM t),
g AS (SELECT *, sum(CASE WHEN held THEN cap ELSE 0 END) OVER () AS hc, sum(CASE WHEN held THEN w ELSE 0 END) OVER () AS hw FROM h),
x AS (SELECT sn, src, CASE WHEN held THEN cap ELSE w * ((total - hc) / (all_w - hw)) END AS target FROM g),
y AS (SELECT k.*, target, floor(target / nullif(source_size, 0)) AS ep,
    coalesce(sum(size) OVER (PARTITION BY k.sn, k.src ORDER BY key, doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM k JOIN x ON k.sn = x.sn AND k.src = x.src),
z AS (SELECT *, CASE WHEN size > 0 THEN ep + CASE WHEN target - ep * source_size > 0 AND b + size / 2
      <= target - ep * source_size THEN 1 ELSE 0 END ELSE 0 END::BIGINT AS times FROM y)
SELECT doc_id, size, source_size, target, times * size AS taken, times FROM z
"""


@register("op6_mix_sources", _OP6_SQL)
def op6_mix_sources(spark, sf):
    """All documents mixed to the weights 5, 2, 1."""
    return mixing.mix_sources(table(spark, sf, "documents"))


_OP10_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.other) AS component_id
FROM d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""


@register("op10_jaccard_join", _OP10_SQL)
def op10_jaccard_join(spark, sf):
    """Components of all documents at 80 per cent of their 5-word shingles."""
    return jaccard.jaccard_components(table(spark, sf, "documents"))


_CRC_OF_ID = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
    lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, e: xor(xor(a, e) >> 1, 3988292384 * (xor(a, e) & 1))), 4294967295)"""


def _op12_leaf(n_chars):
    def item(c):
        return f"coalesce(strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')"
    return "sha256(" + " || ".join(map(item, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


_OP12_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {_op12_leaf("n_chars")} AS leaf,
    CASE WHEN {_CRC_OF_ID} % 7 = 0 THEN {_op12_leaf("n_chars::HUGEINT + 1")} ELSE {_op12_leaf("n_chars")} END AS claim FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY tree) AS n FROM d),
v(k, tree, pos, h, n) AS (SELECT 0, tree, pos, leaf, n FROM l
  UNION ALL SELECT k + 1, tree, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 1) // 2)
  FROM v WHERE n > 1 GROUP BY k, tree, pos // 2),
s AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM v WHERE n = 1),
t(k, pos, h, n) AS (SELECT 0, pos, subroot, n FROM s
  UNION ALL SELECT k + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 1) // 2) FROM t WHERE n > 1 GROUP BY k, pos // 2),
c(doc_id, leaf, tree, k, pos, p, f) AS (SELECT doc_id, leaf, tree, 0, pos, '', claim FROM l
  UNION ALL SELECT c.doc_id, c.leaf, c.tree, c.k + 1, c.pos // 2, c.p || coalesce(o.h, ''),
    sha256(CASE WHEN c.pos % 2 = 1 THEN o.h || c.f ELSE c.f || coalesce(o.h, '') END)
  FROM c JOIN v ON v.k = c.k AND v.tree = c.tree AND v.pos = c.pos AND v.n > 1
  LEFT JOIN v o ON o.k = c.k AND o.tree = c.tree AND o.pos = xor(c.pos, 1)),
e AS (SELECT c.doc_id, c.leaf, s.subroot, s.pos, c.p, c.f FROM c JOIN v ON v.k = c.k AND v.tree = c.tree AND v.n = 1 JOIN s ON s.tree = c.tree),
g(doc_id, leaf, subroot, k, pos, p, f) AS (SELECT doc_id, leaf, subroot, 0, pos, p, f FROM e
  UNION ALL SELECT g.doc_id, g.leaf, g.subroot, g.k + 1, g.pos // 2, g.p || coalesce(o.h, ''),
    sha256(CASE WHEN g.pos % 2 = 1 THEN o.h || g.f ELSE g.f || coalesce(o.h, '') END)
  FROM g JOIN t ON t.k = g.k AND t.pos = g.pos AND t.n > 1 LEFT JOIN t o ON o.k = g.k AND o.pos = xor(g.pos, 1))
SELECT g.doc_id, g.leaf, g.subroot, t.h AS root, sha256(g.p) AS proof_sha256, g.f AS folded_root, g.f = t.h AS verified
FROM g JOIN t ON t.k = g.k AND t.n = 1
"""


@register("op12_merkle_manifest", _OP12_SQL)
def op12_merkle_manifest(spark, sf):
    """Every document's leaf, proof and the root that its (partly tampered) claim climbs to."""
    docs = table(spark, sf, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    leaf = merkle.leaf_hash(*fields)
    changed = merkle.leaf_hash(*fields[:3], fields[3].cast("decimal(20,0)") + 1, fields[4])
    claim = F.when(crc_of_id(F.col("doc_id")) % 7 == 0, changed).otherwise(leaf)
    proofs = merkle.climb(merkle.build(docs, leaf, "lang", "doc_id", claim))
    return proofs.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root",
                         F.sha2(F.lower(F.hex("proof")), 256).alias("proof_sha256"),
                         F.col("folded").alias("folded_root"), "verified")


_OP13_SQL = """
WITH e AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END)::BIGINT AS label,
    list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v, row_number() OVER () AS r FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.r, a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
    list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
q AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, other) AS i FROM p WHERE same QUALIFY i <= 5),
n AS (SELECT q.r, q.i, q.anchor_id, q.other AS positive_id, p.other AS negative_id, q.score AS positive_score,
    p.score AS negative_score, row_number() OVER (PARTITION BY q.r, q.i ORDER BY p.score DESC, p.other)::INT AS rank
  FROM q JOIN p ON p.r = q.r AND NOT p.same AND 50 * q.score <= 100 * p.score AND 100 * p.score <= 95 * q.score QUALIFY rank <= 3)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n
"""


@register("op13_hard_negatives", _OP13_SQL)
def op13_hard_negatives(spark, sf):
    """Hard negatives of every anchor, against all embeddings."""
    relabel = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", relabel.alias("label"))
    return negatives.mine(rows, F.col("vec_id") % 50 == 0)


_OP11_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, t, strlen(t)::BIGINT AS payload_bytes, sha1(t) AS h,
    row_number() OVER (PARTITION BY t ORDER BY page_id DESC NULLS LAST) = 1 AS response,
    first_value(page_id) OVER (PARTITION BY t ORDER BY page_id DESC NULLS LAST) AS first_id FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, (5 * (i // 4) + 1)::INT, 5))::BIGINT
      >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN response THEN NULL ELSE first_id END AS refers_to
FROM d
"""


@register("op11_warc", _OP11_SQL)
def op11_warc(spark, sf):
    """All pages written to archives, index first, and read back through the index."""
    s = Scratch(spark, "warc")
    path = f"{s.root}/archives"
    index = warc.write_archives(table(spark, sf, "pages"), path, s)
    return warc.read_records(index, path, with_payload=False).select(
        F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to_id").cast("long").alias("refers_to"))
