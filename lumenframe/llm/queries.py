"""The registered queries of the operators on the given tables, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, classifier, html, jaccard, lines, mixing, ogg, packing, repair, rules, shards, whitening
from .common import cut, documents, shared_dir

#: The contract's extra conversation.
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


#: A public tokenizer, found where a task runs; a parameter of the operators.
TOKENIZER = "byte_bpe_50k.json"


def op1_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


def op2_ogg_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.unpack(ogg.pack(documents(spark, sf_dir).select("doc_id", "text")))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir).select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


def op4_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = rows.union(spark.range(2).select(F.lit(-1).cast("long"), F.col("id"), F.when(F.col("id") == 0, PROBE[0][2]).otherwise(PROBE[1][2]), F.lit(PROBE[0][3])))
    done = chat.format_chats(rows.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("content")))
    turns = chat.read_turns(F.col("formatted"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = done.withColumn("said", said).withColumn("masked", chat.masked(F.col("formatted"), F.col("loss")))
    return read.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2("said", 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out), "quality")
    done = classifier.score(docs, model)
    return done.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ARRIVALS, SHARD_BYTES = 6, 16 << 20


def op7_shard_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, arriving in parts by doc_id, sharded, compacted as they come, and read back by the manifest."""
    docs = documents(spark, sf_dir)
    store = shards.ShardStore(spark, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}", target_bytes=SHARD_BYTES)
    parts = [i / ARRIVALS for i in range(1, ARRIVALS)]
    cuts, rows, size = docs.agg(F.percentile_approx("doc_id", parts, 1000), F.count("*"), F.sum(F.octet_length("text"))).first()
    bounds = [None, *sorted(set(cuts or [])), None]
    try:
        for low, high in zip(bounds, bounds[1:]):  # ranges of doc_id reach the scan, which passes over other row groups
            part = docs if low is None else docs.filter(F.col("doc_id") > low)
            part = part if high is None else part.filter((F.col("doc_id") <= high) | F.col("doc_id").isNull() if low is None else F.col("doc_id") <= high)
            store.append(part, max_records=max(1, SHARD_BYTES * (rows or 1) // max(1, size or 1)))
            store.compact()
            store.vacuum(keep=1, grace_s=0)  # nobody else knows this store
        text = F.coalesce("text", F.lit(""))
        back = store.read().select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"), "lang", "source")
        return cut(back)
    finally:
        store.drop()


def op8_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    done = rules.cascade(docs, rules.plan(docs), counts=True)
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("rejected_by").isNull().alias("kept"))


def op9_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), TOKENIZER, decoded="decoded")
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage: by a row's number, it goes, loses its text or its stops, comes twice or changes its role."""
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(part[0], F.lit(":"), part[1])) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))
    return rows.drop("copy")


def op11_interval_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    done = repair.report(damaged(rows), rows)
    return done.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op12_jacobi_davidson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def op13_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir).select("doc_id", "text"), TOKENIZER)


QUERIES = {f.__name__: f for f in (op1_text_density, op2_ogg_pages, op3_mix_sources, op4_chat_parts, op5_subword_quality, op6_line_runs, op7_shard_tiers, op8_rule_cascade, op9_bpe_tree, op10_token_groups, op11_interval_repair, op12_jacobi_davidson, op13_swap_packing)}

_CONTROL = r"(<)(\|[a-z_]+\|>|/?s>|/?SYS>>|<SYS>>|</SYS>>)|(\[)(/?INST\])"
_ESC = rf"regexp_replace(replace({{}}, '\', '\\'), '{_CONTROL}', '\1\3\\\2\4', 'g')"
_ADD = "lpad(CAST(CAST(substr({0}, 1, 9) AS INT) + {1} AS VARCHAR), 9, '0') || substr({0}, 10) || '{2}'"


def _add(cell: str, cost: object, letter: str) -> str:
    """A cell, nine digits of cost and the audit, with one more edit; null stays null."""
    return _ADD.format(cell, cost, letter)


_IN_U = [_add(c, "2 + late", "R") for c in ("c0", "cs", "ca")] + [f"CASE WHEN letter = 'u' THEN {_add(c, 'late', 'K')} END" for c in ("c0", "cs", "ca")]
_IN_A = [_add("cu", "2 + late", "R"), f"CASE WHEN letter = 'a' THEN {_add('cu', 'late', 'K')} END"]

ORACLES = {
    "op11_interval_repair": rf"""
WITH RECURSIVE b AS (SELECT conv_id, turn, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
bits AS (SELECT *, list_concat([4294967295::BIGINT], flatten(list_transform(string_split(name, ''), lambda c: list_transform(range(8), lambda i: (CAST(ord(c) AS BIGINT) >> i) & 1)))) AS bits FROM b),
crc AS (SELECT *, xor(list_reduce(bits, lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END), 4294967295::BIGINT) % 20 AS kind FROM bits),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM crc WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, substr(role, 1, 1) AS letter FROM d),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
             WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' ELSE '' END AS fault,
             lag(letter) OVER (PARTITION BY conv_id ORDER BY pos) || letter NOT IN ('su', 'ua', 'au') AS illegal FROM o),
dp AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS step, '000000000' AS c0, CAST(NULL AS VARCHAR) AS cs, '000000002I' AS cu, '000000004II' AS ca FROM b
       UNION ALL
       SELECT conv_id, step, c0, cs, least(cu, {_add("c0", 2, "I")}, {_add("cs", 2, "I")}, {_add("ca", 2, "I")}),
              least(ca, {_add("cu", 2, "I")}, {_add("c0", 4, "II")}, {_add("cs", 4, "II")})
       FROM (SELECT conv_id, pos AS step, {_add("c0", 3, "D")} AS c0,
                    least({_add("cs", 3, "D")}, CASE WHEN stays AND letter = 's' THEN {_add("c0", "late", "K")} END) AS cs,
                    least({_add("cu", 3, "D")}, CASE WHEN stays THEN least({", ".join(_IN_U)}) END) AS cu,
                    least({_add("ca", 3, "D")}, CASE WHEN stays THEN least({", ".join(_IN_A)}) END) AS ca
             FROM (SELECT dp.*, f.pos, f.letter, f.fault IN ('', 'truncated') AS stays, CAST(f.fault = 'truncated' AS INT) AS late
                   FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.pos = dp.step + 1))),
won AS (SELECT conv_id, CAST(substr(least(c0, ca), 1, 9) AS BIGINT) AS cost, substr(least(c0, ca), 10) AS audit FROM dp QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY step DESC) = 1),
l AS (SELECT conv_id, n, e, count(*) FILTER (e <> 'I') OVER w AS pos, count(*) FILTER (e <> 'D') OVER w AS out, count(*) FILTER (e <> 'D') OVER (PARTITION BY conv_id) % 2 AS odd
      FROM (SELECT conv_id, unnest(range(1, len(audit) + 1)) AS n, unnest(string_split(audit, '')) AS e FROM won WHERE audit <> '') WINDOW w AS (PARTITION BY conv_id ORDER BY n)),
r AS (SELECT l.conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (out - odd) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY out) AS said
      FROM l LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.pos = l.pos WHERE e <> 'D' GROUP BY l.conv_id),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
             count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal FROM f GROUP BY conv_id)
SELECT won.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       cost, audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM won LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM won.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM won.conv_id""",
    "op4_chat_parts": rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length({_ESC.format("role")}) + length({_ESC.format("text")}) + 32) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id""",
    "op6_line_runs": r"""
WITH l AS (SELECT doc_id, generate_subscripts(s, 1) AS pos, unnest(s) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (o.owner < k.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (o.owner IS NULL OR o.owner >= k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN o USING (key) GROUP BY k.doc_id""",
    "op7_shard_tiers": "SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes, sha256(coalesce(text, '')) AS text_sha256, lang, source FROM documents",
    "op8_rule_cascade": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c >= 2),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM dup) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
       FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (SELECT w.doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')) AS up, length(text) - length(regexp_replace(text, '\p{L}', '', 'g')) AS letters,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM w LEFT JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 2 * up > letters OR 2 * n_dup_lines > n_lines OR NOT word_chars BETWEEN 2 * n_words AND 15 * n_words) AS kept
FROM b""",
}
