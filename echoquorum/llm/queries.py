"""The registered queries of the corpus operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, edits, langid, lines, mixing, passages, quality, resample, search, sharding, simhash, tokens, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", *quality.MEASURES, "base_failed", "kept")


#: Target weights of the mixture query, by path in the tree; a path that isn't named weighs 1.
WEIGHTS = {
    "d0": 5, "d1": 3, "d2": 2, "d3": 2,
    "d0/en": 6, "d0/de": 2, "d1/en": 3, "d2/fr": 2, "d3/es": 4,
    "d0/en/src0": 2, "d1/en/src0": 2, "d2/en/src0": 3, "d3/en/src0": 2,
}
MIX_SEED, MIX_EPOCHS = 17, 2


def domain_of(source):
    """The corpus names no domains; sources are dealt into four by the first digit of their name's MD5."""
    digit = F.conv(F.substring(F.md5(F.coalesce(source, F.lit("")).cast("binary")), 1, 1), 16, 10).cast("int")
    return F.concat(F.lit("d"), (digit % 4).cast("string"))


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(
        table(spark, sf_dir, "documents"), WEIGHTS, max_epochs=MIX_EPOCHS, seed=MIX_SEED, domain=domain_of(F.col("source"))
    )
    return out.select(F.col("id").cast("long").alias("doc_id"), "domain", "lang", "source", F.col("tokens").alias("n_tokens"), "copies")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return judged.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def script(text):
    """The edits of the token-count query, for every document: an insertion, a deletion and a replacement."""
    n = F.char_length(F.coalesce(text, F.lit("")))
    step = lambda pos, drop, put: F.struct(pos.cast("int").alias("pos"), F.lit(drop).alias("drop"), F.lit(put).alias("put"))
    return F.array(step(F.floor(n / 3), 0, " It's the 2nd edit,\n\n  isn't it? "), step(F.floor(n / 2), 7, ""), step(F.floor(n * 3 / 4), 5, "x1"))


def op5_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    how = str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents")
    counted = edits.count_tokens(docs, *how, extra={"edits": script(F.col("text"))})
    out = edits.apply_edits(counted, *how)
    return out.select("doc_id", "n_tokens_before", "n_tokens", "n_encoded", F.sha2("text", 256).alias("text_sha256"))


def word_tokenizer() -> str:
    """The place of the tokenizer file that the token queries use."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read_tokens(tokens.write_tokens(table(spark, sf_dir, "documents"), word_tokenizer()))


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign_shards(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"), min_run=passages.MIN_RUN)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf_dir, "pages"), min_bytes=0)
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(table(spark, sf_dir, "documents"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, min_words=20, seed=42)


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


QUERIES = {
    "op1_mix": op1_mix,
    "op2_decontaminate": op2_decontaminate,
    "op3_lines": op3_lines,
    "op4_simhash": op4_simhash,
    "op5_edits": op5_edits,
    "op6_tokens": op6_tokens,
    "op7_quality": op7_quality,
    "op8_shards": op8_shards,
    "op9_passages": op9_passages,
    "op10_warc": op10_warc,
    "op11_language": op11_language,
    "op12_resample": op12_resample,
    "op13_search": op13_search,
}

_RULES = quality.Rules()

OP7_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(source, chr(1) || 'null') AS host, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents
), w AS (
  SELECT r, list_filter(regexp_split_to_array(t, '[ \\t-\\r]+'), lambda x: x <> '') AS ws,
         string_split(t, chr(10)) AS ls,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols
  FROM d
), l AS (
  SELECT r, len(ls) AS n_lines, list_filter(ls, lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS full_ls FROM w
), runs AS (
  SELECT r, i, list_slice(ws, i, i + 7) AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
), hit AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM runs) WHERE c > 1
), cov AS (
  SELECT r, sum(least(8, nxt - i)) AS n FROM (
    SELECT r, i, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i), i + 8) AS nxt FROM hit) GROUP BY r
), m AS (
  SELECT d.r, doc_id, host, len(ws)::BIGINT AS n_words,
         length(array_to_string(ws, ''))::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
         (len(full_ls) - len(list_distinct(full_ls)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words, n_lines
  FROM d JOIN w USING (r) JOIN l USING (r) LEFT JOIN cov USING (r)
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
), x AS (
  SELECT *, base_failed OR 100 * n_symbols > {_RULES.max_symbol_percent} * greatest(n_words, 1)
      OR 100 * n_dup_lines > {_RULES.max_dup_line_percent} * greatest(n_lines, 1)
      OR word_chars < {_RULES.min_mean_word_chars} * n_words
      OR word_chars > {_RULES.max_mean_word_chars} * greatest(n_words, 1) AS failed
  FROM b
), f AS (
  SELECT host, count(*) AS n, count(*) FILTER (failed) AS k FROM x GROUP BY host
), p AS (
  SELECT avg(k / n) AS mu, var_pop(k / n) - avg(k / n) * (1 - avg(k / n)) * avg(1 / n) AS v, count(*) AS hosts FROM f
), s AS (
  SELECT mu, CASE WHEN hosts < 2 OR mu * (1 - mu) <= 0 THEN 1.0 WHEN v > 0
      THEN least(greatest(mu * (1 - mu) / v - 1, 1.0), {_RULES.max_prior_docs}) ELSE {_RULES.max_prior_docs} END AS z FROM p
), h AS (
  SELECT host, (k + mu * z) / (n + z) AS rate FROM f, s
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR rate > {_RULES.max_host_rate} OR (failed AND rate > {_RULES.max_trusted_rate})) AS kept
FROM x JOIN h USING (host)
"""

OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), win AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + 12), ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM b WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT n FROM win
), dw AS (
  SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), hit AS (
  SELECT r, i, dw.n, item FROM dw JOIN win USING (n, g)
), pos AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r
), its AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""

OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT r, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d
), k AS (
  SELECT r, pos, line, translate(trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), gone AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10
), j AS (
  SELECT r, count(*) AS n_lines, count(gone.key) AS n_dropped,
         string_agg(line, chr(10) ORDER BY pos) FILTER (gone.key IS NULL) AS kept
  FROM k LEFT JOIN gone USING (key) GROUP BY r
)
SELECT doc_id, n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM d JOIN j USING (r)
"""



def _fill_sql(source: str, parent: str, name: str) -> str:
    """SQL for ``mixing.fill`` over rows with budget, weight and cap."""
    part = lambda w: f"(rest_b::HUGEINT * ({w})) // greatest(rest_w, 1)"
    order = f"PARTITION BY {parent} ORDER BY CASE WHEN weight > 0 THEN cap::DOUBLE / weight END NULLS LAST, {name} NULLS FIRST"
    return f"""
      SELECT *, CASE WHEN is_full THEN cap ELSE ({part("to_w")} - {part("to_w - weight")})::BIGINT END AS share FROM (
        SELECT *, greatest(budget - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (PARTITION BY {parent}), 0), 0)::BIGINT AS rest_b,
               coalesce(sum(CASE WHEN NOT is_full THEN weight END) OVER (PARTITION BY {parent}), 0)::BIGINT AS rest_w,
               sum(CASE WHEN NOT is_full THEN weight ELSE 0 END) OVER ({order} ROWS UNBOUNDED PRECEDING)::BIGINT AS to_w
        FROM (SELECT *, weight > 0 AND cap::HUGEINT * w_left <= b_left * weight AS is_full FROM (
            SELECT *, sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS w_left,
                   greatest(budget - coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)::HUGEINT AS b_left
            FROM {source})))"""


OP1_SQL = f"""
WITH weights(path, w) AS (VALUES {", ".join(f"('{p}', {w})" for p, w in sorted(WEIGHTS.items()))}),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id::VARCHAR, '') AS id,
         'd' || ((('0x' || substr(md5(coalesce(source, '')), 1, 1))::INT) % 4)::VARCHAR AS domain,
         coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+'))::BIGINT AS tokens
  FROM documents
), rows_ AS (
  SELECT * FROM docs WHERE tokens > 0
), leaves AS (
  SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, {MIX_EPOCHS} * sum(tokens)::BIGINT AS cap FROM rows_ GROUP BY ALL
), langs AS (
  SELECT domain, lang, sum(cap)::BIGINT AS cap FROM leaves GROUP BY ALL
), domains AS (
  SELECT domain, sum(cap)::BIGINT AS cap, (SELECT sum(tokens) FROM leaves)::BIGINT AS budget, coalesce(any_value(w), 1)::BIGINT AS weight, 0 AS root
  FROM langs LEFT JOIN weights ON path = domain GROUP BY domain
), d_share AS ({_fill_sql("domains", "root", "domain")}
), l_in AS (
  SELECT langs.domain, lang, langs.cap, d_share.share AS budget, coalesce(w, 1)::BIGINT AS weight
  FROM langs JOIN d_share USING (domain) LEFT JOIN weights ON path = langs.domain || '/' || lang
), l_share AS ({_fill_sql("l_in", "domain", "lang")}
), s_in AS (
  SELECT leaves.domain, leaves.lang, source, tokens, leaves.cap, l_share.share AS budget, coalesce(w, 1)::BIGINT AS weight
  FROM leaves JOIN l_share USING (domain, lang) LEFT JOIN weights ON path = leaves.domain || '/' || leaves.lang || '/' || source
), s_share AS ({_fill_sql("s_in", "domain, lang", "source")}
), ordered AS (
  SELECT rows_.*, share // s.tokens AS epochs, share % s.tokens AS rest,
         md5('{MIX_SEED}:' || (share // s.tokens)::VARCHAR || ':' || id) AS o
  FROM rows_ JOIN s_share s USING (domain, lang, source)
), upto AS (
  SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY o, id, r ROWS UNBOUNDED PRECEDING) AS c FROM ordered
)
SELECT doc_id, domain, lang, source, tokens AS n_tokens, (epochs + CASE WHEN c <= rest THEN 1 ELSE 0 END)::BIGINT AS copies
FROM upto WHERE epochs + CASE WHEN c <= rest THEN 1 ELSE 0 END > 0
"""


def _crc_table() -> list[int]:
    """CRC-32 of each byte, by the reflected polynomial 0xEDB88320."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


OP8_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t, (strlen(coalesce(text, '')) + 8)::BIGINT AS size FROM documents
), crc AS (
  SELECT r, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, 2 * (size - 8) + 1, 2),
                  lambda i: (16 * (strpos('0123456789ABCDEF', substr(h, i, 1)) - 1) + strpos('0123456789ABCDEF', substr(h, i + 1, 1)) - 1)::UBIGINT)),
                lambda c, b: xor(c >> 8, list_extract({_crc_table()}::UBIGINT[], ((xor(c, b) & 255) + 1)::BIGINT))), 4294967295::UBIGINT)::BIGINT AS text_crc32
  FROM (SELECT r, size, hex(encode(t)) AS h FROM d)
), lv AS (
  SELECT v AS lang_, (16 * (row_number() OVER (ORDER BY encode(v)) - 1)) // count(*) OVER () AS lang_level
  FROM (SELECT DISTINCT coalesce(lang, '') AS v FROM documents)
), sv AS (
  SELECT v AS source_, (16 * (row_number() OVER (ORDER BY encode(v)) - 1)) // count(*) OVER () AS source_level
  FROM (SELECT DISTINCT coalesce(source, '') AS v FROM documents)
), k AS (
  SELECT d.*, text_crc32,
         {list(sharding.hilbert_table(3, 4))}[1 + 256 * lang_level + 16 * source_level + least(15, greatest(0, length(bin(size)) - 4))] AS cell,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || text_crc32::VARCHAR) AS o
  FROM d JOIN crc USING (r) JOIN lv ON lang_ = coalesce(lang, '') JOIN sv ON source_ = coalesce(source, '')
), p AS (
  SELECT *, row_number() OVER (ORDER BY cell, o, doc_id NULLS FIRST, size, text_crc32) - 1 AS rank, count(*) OVER () AS n FROM k
), c AS (
  SELECT *, n // 24 AS base, (n % 24) * (n // 24 + 1) AS first FROM p
)
SELECT doc_id, size, text_crc32, 'rows' AS law,
       (CASE WHEN rank < first THEN rank // (base + 1) ELSE n % 24 + (rank - first) // greatest(base, 1) END)::INT AS shard,
       (CASE WHEN rank < first THEN rank % (base + 1) ELSE (rank - first) % greatest(base, 1) END)::BIGINT AS slot,
       NULL::INT AS grown_shard
FROM c
"""

OP10_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform(range(4), lambda k:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (5 * g + 1)::INT, 5))::BIGINT >> (15 - 5 * k)::INT) & 31) + 1)::INT, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

# CRC-32 of a run's bytes, for each distinct run: one step a byte through the table of 256 remainders.
OP12_SQL = f"""
WITH src AS (
  SELECT 0 AS side, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark
), w AS (
  SELECT side, r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                            '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM src
), f AS (
  SELECT side, r, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
  FROM (SELECT side, r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS sizes(k) WHERE len(w) >= k)
), n AS (
  SELECT side, r, g, count(*) AS c FROM f GROUP BY ALL
), b AS (
  SELECT g, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(h), 2),
               lambda i: (16 * (strpos('0123456789ABCDEF', substr(h, i, 1)) - 1) + strpos('0123456789ABCDEF', substr(h, i + 1, 1)) - 1)::UBIGINT)),
             lambda c, x: xor(c >> 8, list_extract({_crc_table()}::UBIGINT[], ((xor(c, x) & 255) + 1)::BIGINT))), 4294967295::UBIGINT) % 10000 AS bucket
  FROM (SELECT g, hex(encode(g)) AS h FROM (SELECT DISTINCT g FROM n))
), sums AS (
  SELECT bucket, sum(c) FILTER (side = 0) AS s, sum(c) FILTER (side = 1) AS t FROM n JOIN b USING (g) GROUP BY bucket
), every AS (
  SELECT range AS bucket, coalesce(s, 0)::DOUBLE AS s, coalesce(t, 0)::DOUBLE AS t FROM range(10000) LEFT JOIN sums ON bucket = range
), gain AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * ((SELECT sum(s) FROM every) + 10000)) / ((s + 1) * ((SELECT sum(t) FROM every) + 10000))))::BIGINT AS gain FROM every
), weight AS (
  SELECT r, sum(c)::BIGINT AS n_features, sum(c * gain)::BIGINT AS weight FROM n JOIN b USING (g) JOIN gain USING (bucket) WHERE side = 0 GROUP BY r
), scored AS (
  SELECT r, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM w LEFT JOIN weight USING (r) WHERE side = 0
), ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN rank <= 5 * n // 100 THEN rank END::BIGINT AS rank
FROM scored LEFT JOIN ranked USING (r)
"""

OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), q AS (
  SELECT i, item_id, unnest(w) AS term FROM (SELECT row_number() OVER () AS i, item_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark)
), sums AS (
  SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0
), p AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL
), weight AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight
  FROM (SELECT term, count(*) AS df FROM p GROUP BY term), sums
), gain AS (
  SELECT r, doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(w) * n_docs) // n_terms))) AS gain
  FROM p JOIN d USING (r) JOIN weight USING (term), sums
), scored AS (
  SELECT i, item_id, r, doc_id, sum(gain)::BIGINT AS score FROM q JOIN gain USING (term) GROUP BY ALL
)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""

ORACLE = {
    "op1_mix": OP1_SQL,
    "op2_decontaminate": OP2_SQL,
    "op3_lines": OP3_SQL,
    "op7_quality": OP7_SQL,
    "op8_shards": OP8_SQL,
    "op10_warc": OP10_SQL,
    "op12_resample": OP12_SQL,
    "op13_search": OP13_SQL,
}
