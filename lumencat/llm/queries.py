"""Operators 1 to 13 over their whole tables, with the parameters of production."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from lumencat.llm import (
    chat, decontaminate, hamming_join, merkle, mixing, quality_rules, rollups, shards, shingle_join, token_files, toxicity, warc,
    whitening,
)
from lumencat.llm.registry import ORACLE, QUERIES, query, table  # noqa: F401
from lumencat.sources.storage import fresh_path, materialize

TOKENIZER = "byte_bpe_50k.json"


@query
def op1_token_files(spark, sf_dir):
    """Encode, write and read back; the digests come from the files."""
    path = token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), added_tokens=True)
    return token_files.read(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"),
    )


@query
def op10_shingle_join(spark, sf_dir):
    return shingle_join.join(table(spark, sf_dir, "documents"))


@query
def op5_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = F.array_join(F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))), ",")
    return decontaminate.judge(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", F.greatest(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(items, F.lit("")), 256).alias("items_sha256"), "contaminated",
    )


ORACLE["op5_decontaminate"] = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), g AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, w[i:i + least(len(w), 13) - 1] AS gram
  FROM b, LATERAL unnest(range(1, len(w) - least(len(w), 13) + 2)) AS t(i) WHERE len(w) > 0
), hit AS (
  SELECT doc_id, i, g.n, item_id
  FROM (SELECT DISTINCT n FROM g) lens, w, LATERAL unnest(range(1, len(w) - lens.n + 2)) AS t(i)
  JOIN g ON g.n = lens.n AND g.gram = w.w[i:i + lens.n - 1]
), places AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM w LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op6_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_rules.judge(docs, table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
    )


def _quality_sql() -> str:
    measures = {
        "symbols": "coalesce(n_symbols / nullif(word_chars, 0), 0)",
        "dup_lines": "coalesce(n_dup_lines / nullif(n_lines, 0), 0)",
        "repeats": "coalesce(n_repeat_words / nullif(n_words, 0), 0)",
        "long_words": "coalesce(word_chars / nullif(n_words, 0), 0)",
        "short_words_under": "-coalesce(word_chars / nullif(n_words, 0), 0)",
    }
    sign = {rule: -1 if rule.endswith("_under") else 1 for rule in measures}
    grid = ", ".join(
        f"('{rule}', {k}, CAST({sign[rule] * c!r} AS DOUBLE))"
        for rule, cutoffs in quality_rules.CUTOFFS.items() for k, c in enumerate(cutoffs)
    )
    rate = quality_rules.RISK / len(measures)
    each = " UNION ALL ".join(f"SELECT doc_id, lang, base_failed, '{r}' AS rule, CAST({m} AS DOUBLE) AS v FROM base" for r, m in measures.items())
    return rf"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') <> '') AS l FROM t),
windows AS (SELECT doc_id, i, w[i:i + 7] AS g FROM w, LATERAL unnest(range(1, len(w) - 6)) AS r(i)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM again) GROUP BY doc_id),
m AS (SELECT doc_id, lang, CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  len(l) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM w LEFT JOIN repeated USING (doc_id)),
base AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
v AS ({each}),
grid AS (SELECT * FROM (VALUES {grid}) AS g(rule, k, cutoff)),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
tests AS (SELECT lang, rule, k, cutoff, count(*) AS n, count(*) FILTER (v > cutoff) AS x
  FROM v JOIN grid USING (rule) WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good) GROUP BY ALL),
tails AS (SELECT *, CASE WHEN x > n * {rate!r} THEN 1.0 ELSE list_sum(list_transform(range(0, x + 1),
  lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({rate!r}) + (n - j) * ln(1 - {rate!r})))) END AS p FROM tests),
chosen AS (SELECT lang, rule, arg_max(cutoff, k) AS cutoff FROM tails
  WHERE p * (SELECT count(*) FROM tests) <= {quality_rules.ERROR!r} GROUP BY lang, rule),
bad AS (SELECT DISTINCT doc_id FROM v JOIN chosen ON v.rule = chosen.rule AND v.lang IS NOT DISTINCT FROM chosen.lang WHERE v.v > chosen.cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept
FROM base
"""


ORACLE["op6_quality_rules"] = _quality_sql()


@query
def op3_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs).select(F.col("key").alias("doc_id"), "source", "block", "release", "due", "slot", "place")


@query
def op4_shards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    )
    return shards.assign(docs, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op7_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels")
    scored = materialize(toxicity.score(docs, toxicity.fit(docs, labels)), "scores")
    return toxicity.judge(scored, toxicity.thresholds(scored, labels)).select(
        "doc_id", (toxicity.fold() == toxicity.HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", "toxic",
    )


@query
def op2_chat(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", marks), (-7, 1, "assistant", marks)], "conv_id long, turn long, role string, text string")
    path = chat.write(chat.format_turns(turns.unionByName(own)))
    return chat.digests(chat.read(spark, path))


def _chat_sql() -> str:
    t = chat.TEMPLATE
    marks = " + ".join(f"(length(x) - length(replace(x, '{c}', ''))) / {len(c)}" for c in t.controls)
    size = f"length(x) + length(x) - length(replace(x, chr(92), '')) + {marks}"
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), s AS (
  SELECT *, lag(role) OVER w AS before, lag(turn) OVER w AS turn_before FROM c
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({sum(map(len, t.controls))} + {size.replace('x', 'role')} + {size.replace('x', 'text')}) AS BIGINT) AS formatted_chars,
  count(*) FILTER (turn_before = turn OR NOT coalesce(CASE
    WHEN before IS NULL THEN role IN ('system', 'user') WHEN before = 'system' THEN role = 'user'
    WHEN before = 'user' THEN role = 'assistant' WHEN before = 'assistant' THEN role = 'user' END, false)) AS n_problems
FROM s GROUP BY conv_id
""".replace("turn_before = turn OR", "coalesce(turn_before = turn, false) OR")


ORACLE["op2_chat"] = _chat_sql()

_WORDS = r"[^\x20\x09-\x0D]+"
_PIECES = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"


@query
def op8_token_rollup(spark, sf_dir):
    """Load with words, load pieces as estimated, revise them to what is counted, drop exact copies."""
    counted = materialize(
        table(spark, sf_dir, "documents").select(
            "doc_id", "source", "lang", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"),
            F.coalesce(F.regexp_count("text", F.lit(_WORDS)), F.lit(0)).cast("long").alias("words"),
            F.coalesce(F.regexp_count("text", F.lit(_PIECES)), F.lit(0)).cast("long").alias("pieces"),
            F.ceil(F.coalesce(F.length("text"), F.lit(0)) / 5).alias("guess"),
        ), "counts",
    )
    firsts = counted.groupBy(F.col("digest").alias("copied")).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = counted.join(firsts, (F.col("digest") == F.col("copied")) & (F.col("doc_id") != F.col("first")))

    def changes(rows, kind, tokenizer, n, old=None):
        return rows.select(
            F.lit(kind).alias("kind"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.col(n).alias("n_tokens"),
            (F.col(old) if old else F.lit(None).cast("long")).alias("old_tokens"),
        )

    store = rollups.Rollup(spark, fresh_path(spark, "rollup"))
    revised = changes(counted, "revise", "pieces-1", "pieces", "guess")
    store.commit("load", changes(counted, "insert", "words-1", "words").union(changes(counted, "insert", "pieces-1", "guess")))
    store.commit("revise", revised)
    store.compact()
    store.commit("drop", changes(copies, "delete", "words-1", "words").union(changes(copies, "delete", "pieces-1", "pieces")))
    store.commit("revise", revised)  # comes again and counts once
    return store.totals()


ORACLE["op8_token_rollup"] = rf"""
WITH t AS (
  SELECT source, lang, len(regexp_extract_all(coalesce(text, ''), '{_WORDS}')) AS words,
    len(regexp_extract_all(coalesce(text, ''), '{_PIECES}')) AS pieces
  FROM documents QUALIFY doc_id = min(doc_id) OVER (PARTITION BY coalesce(text, ''))
)
SELECT source, lang, 'words-1' AS tokenizer, count(*) AS docs, CAST(sum(words) AS BIGINT) AS tokens FROM t GROUP BY ALL
UNION ALL SELECT source, lang, 'pieces-1', count(*), CAST(sum(pieces) AS BIGINT) FROM t GROUP BY ALL
"""


@query
def op9_warc(spark, sf_dir):
    path = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE["op9_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS size FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p
)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN size >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN size >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""


@query
def op11_hamming_join(spark, sf_dir):
    return hamming_join.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op12_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query
def op13_merkle_manifest(spark, sf_dir):
    """Every seventh document, by the crc of its id, is folded as if its n_chars were one more."""
    docs = table(spark, sf_dir, "documents").select(*merkle.FIELDS)
    more = [F.col("n_chars") + 1 if f == "n_chars" else f for f in merkle.FIELDS]
    rows = docs.select(
        "doc_id", "lang", merkle.leaf(merkle.FIELDS).alias("leaf"),
        F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, merkle.leaf(more)).alias("claimed"),
    )
    return merkle.prove(materialize(rows, "leaf"))


_BITS = "list_transform(range(0, 8 * length(x)), lambda i: (ascii(x[(i // 8 + 1)::BIGINT]) >> (i % 8)::INTEGER) & 1)"
ORACLE["op13_merkle_manifest"] = f"""
WITH RECURSIVE d AS (
  SELECT *, CAST(doc_id AS VARCHAR) AS x, xor(list_reduce({_BITS.replace("x", "CAST(doc_id AS VARCHAR)")},
    lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, 4294967295), 4294967295) AS crc
  FROM documents
), f AS (
  SELECT *,
    coalesce(octet_length(encode(x)) || ':' || x, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
    coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail, CAST(n_chars AS VARCHAR) AS c, CAST(n_chars + 1 AS VARCHAR) AS c1
  FROM d
), l AS (
  SELECT doc_id, lang, sha256(head || coalesce(length(c) || ':' || c, '-') || tail) AS leaf,
    CASE WHEN crc % 7 = 0 THEN sha256(head || coalesce(length(c1) || ':' || c1, '-') || tail) END AS claimed,
  FROM f
), p AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l
), t AS (
  SELECT lang, 0 AS lvl, pos, leaf AS node, count(*) OVER (PARTITION BY lang) AS n FROM p
  UNION ALL
  SELECT lang, lvl + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY lang, lvl, pos // 2, n
), s AS (
  SELECT lang, node AS subroot, lvl AS height, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS nth FROM t WHERE n = 1
), u AS (
  SELECT 0 AS lvl, nth AS pos, subroot AS node, count(*) OVER () AS n FROM s
  UNION ALL
  SELECT lvl + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY lvl, pos // 2, n
), nodes AS (
  SELECT nth, lvl, pos, node FROM t JOIN s ON t.lang IS NOT DISTINCT FROM s.lang WHERE lvl < height
  UNION ALL
  SELECT nth, height + u.lvl, u.pos, u.node FROM u, s WHERE u.n > 1
), walk AS (
  SELECT doc_id, leaf, nth, subroot, p.pos AS own, 0 AS lvl, p.pos AS pos, coalesce(claimed, leaf) AS folded, '' AS proof,
    height, height + (SELECT max(lvl) FROM u) AS top
  FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang
  UNION ALL
  SELECT doc_id, leaf, w.nth, subroot, own, w.lvl + 1,
    CASE WHEN w.lvl + 1 = height THEN w.nth ELSE w.pos // 2 END,
    sha256(CASE WHEN w.pos % 2 = 1 THEN coalesce(o.node, '') || folded ELSE folded || coalesce(o.node, '') END), proof || coalesce(o.node, ''), height, top
  FROM (SELECT * REPLACE (CASE WHEN lvl = height THEN nth ELSE pos END AS pos) FROM walk WHERE lvl < top) w
  LEFT JOIN nodes o ON o.nth = w.nth AND o.lvl = w.lvl AND o.pos = xor(w.pos, 1)
)
SELECT doc_id, leaf, subroot, node AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = node AS verified
FROM walk, (SELECT node FROM u WHERE n = 1) WHERE walk.lvl = top
"""
