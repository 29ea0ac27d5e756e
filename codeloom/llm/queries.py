"""Queries op1 to op13 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import bpe, chat, chunks, decontaminate, elkan, fixity, inner_products, ordered_minhash, pages, quality, resampling, toxicity, urls, vectors
from codeloom.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc.doc_id",
        *("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"),
        (~quality.passes(quality.BASE)).alias("base_failed"),
        quality.passes(quality.CURRENT).alias("kept"),
        "failed_bits",
    )


OP1_SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines
  from documents),
starts as (select doc_id, text, words, unnest(generate_series(1, len(words) - 7)) as pos from d where len(words) >= 8),
spans as (select doc_id, pos, count(*) over (partition by doc_id, words[pos:pos + 7]) as n from starts),
seen as (select distinct doc_id, pos + k as word from spans, generate_series(0, 7) g(k) where n > 1),
rep as (select doc_id, count(*) as n from seen group by doc_id),
m as (
  select d.doc_id, len(words) as n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
         len(lines) - len(list_distinct(lines)) as n_dup_lines,
         coalesce(rep.n, 0) as n_repeat_words,
         len(lines) as n_lines,
         len(list_filter(generate_series(2, len(words)), lambda i: words[i] = words[i - 1])) as n_stutter,
         len(list_distinct(words)) as n_distinct_words
  from d left join rep on rep.doc_id = d.doc_id),
b as (
  select *,
    (case when n_words < 20 then 1 else 0 end) + (case when 100 * n_repeat_words > 30 * n_words then 2 else 0 end)
    + (case when 10 * n_symbols > n_words then 4 else 0 end) + (case when 100 * n_stutter > 20 * n_words then 8 else 0 end)
    + (case when n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines then 16 else 0 end)
    + (case when word_chars > 40 * n_words then 32 else 0 end)
    + (case when n_words >= 50 and 100 * n_distinct_words < 10 * n_words then 64 else 0 end) as bits
  from m)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
       cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
       (bits & 3) <> 0 as base_failed, bits = 0 as kept, cast(bits as bigint) as failed_bits
from b
"""


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy does, from the ledger's bits alone."""
    return quality.ablate(quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))


def _ablations_sql() -> str:
    marks = ", ".join(f"('{p.version}', {p.mask}, '{r.name}', {1 << k})" for p in quality.POLICIES for k, r in enumerate(quality.RULES) if p.mask >> k & 1)
    return f"""select policy, rule, count(*) filter (failed_bits & mask = 0) as kept, count(*) filter (failed_bits & bit <> 0) as failing, count(*) filter (failed_bits & mask = bit) as only_this_rule
from ({OP1_SQL}) l, (values {marks}) m(policy, mask, rule, bit) group by policy, rule"""


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ordered_minhash.classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "class_size", F.expr("id <=> class_id").alias("kept"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_texts(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks.remove_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc.doc_id", F.col("kept").alias("text"), "n_removed", "removed_chars")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), vocabulary())


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as WARC files against a replica with bytes changed in some records and some records gone."""
    records = fixity.warc_records(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    spoilt = records.withColumn("data", F.when(F.col("page_id") % 97 == 13, F.concat(F.lit(b"w"), F.substring("data", 2, 1 << 30))).otherwise(F.col("data")))
    first = fixity.placed(records)
    found = fixity.audit(first, fixity.placed(spoilt).where("page_id % 193 <> 7 or page_id is null"))
    ids = first.select("page_id", F.col("file").alias("_file"), F.col("offset").alias("_offset"))
    return found.join(ids, F.expr("file <=> _file and offset = _offset"), "left").select("page_id", "file", "offset", "status")


OP5_SQL = r"""
with r as (
  select page_id, 'pages-' || lpad(cast(page_id // 500 as varchar), 6, '0') || '.warc' as file,
         strlen('WARC/1.0' || 'WARC-Type: response' || 'WARC-Record-ID: <urn:page:' || page_id || '>' || 'WARC-Target-URI: ' || coalesce(url, '')
                || 'Content-Type: text/html; charset=utf-8' || 'Content-Length: ' || strlen(coalesce(html, ''))) + 14 + strlen(coalesce(html, '')) + 4 as size
  from pages),
p as (select page_id, file, coalesce(sum(size) over (partition by file order by page_id rows between unbounded preceding and 1 preceding), 0) as "offset" from r)
select page_id, file, cast("offset" as bigint) as "offset", case when page_id % 193 = 7 then 'missing' else 'changed' end as status
from p where page_id % 193 = 7 or page_id % 97 = 13
"""


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are control strings."""
    said = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    formatted = chat.format_records(chat.records_of(said.unionByName(extra)))
    return chat.digests(formatted).withColumnRenamed("id", "conv_id")


def _escaped_length(text: str) -> str:
    """SQL: length of an escaped text, which has one more character for each backslash and each control string."""
    return f"length({text})" + "".join(f" + (length({text}) - length(replace({text}, '{c}', ''))) // {len(c)}" for c in ("\\", *chat.CONTROL))


OP8_SQL = f"""
with said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
talks as (
  select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns,
         coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '') as loss,
         sum({len(chat.START) + len(chat.MIDDLE) + len(chat.END)} + {_escaped_length("role")} + {_escaped_length("text")}) as formatted_chars
  from said group by conv_id)
select cast(conv_id as bigint) as conv_id, n_turns, sha256(turns) as turns_sha256, cast(length(loss) as bigint) as loss_chars, sha256(loss) as loss_sha256,
       cast(formatted_chars as bigint) as formatted_chars
from talks
"""


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", "url")
    trained = urls.UrlFilter(urls.weak_labels(found.where(~urls.held_out(F.col("url")))))
    judged = trained.judge(found)
    return judged.select("row.page_id", "host", "path", "rule", "verdict", "model_verdict", urls.held_out(F.col("row.url")).alias("held_out"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    index, every = toxicity.train(docs, labels.where(~held_out))
    scored = toxicity.score(every, index)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "neighbours")


def op11_elkan_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = elkan.clusters(table(spark, sf_dir, "embeddings"))
    return elkan.with_inertia(found, centroids).select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


#: Integer vectors that take part, numbered.
VECTORS_SQL = f"""v as materialized (
  select row_number() over () as k, vec_id, list_transform(embedding, lambda x: cast(floor({vectors.SCALE} * cast(x as double)) as bigint)) as x
  from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is not null and isfinite(x) and abs({vectors.SCALE} * cast(x as double)) <= {vectors.LARGEST})) = len(embedding)%s)"""


def _clusters_sql() -> str:
    """Lloyd's rounds, one after another: all distances, the nearest centroid, floored means."""
    parts = [VECTORS_SQL % f" and len(embedding) = {elkan.COMPONENTS}"]
    parts.append(f"c0 as materialized (select row_number() over (order by sha256('{elkan.SEED}' || vec_id) nulls last, x) - 1 as c, x as at from v qualify c < {elkan.CENTROIDS})")
    for n in range(elkan.ROUNDS + 1):
        square = "list_sum(list_transform(list_zip(v.x, m.at), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
        parts.append(f"a{n} as materialized (select k, min({{'d': cast({square} as bigint), 'c': m.c}}) as near from v, c{n} m group by k)")
        if n < elkan.ROUNDS:
            means = f"select near.c as c, i, sum(x[i]) as s, count(*) as n from a{n} join v using (k), generate_series(1, {elkan.COMPONENTS}) g(i) group by 1, 2"
            parts.append(f"c{n + 1} as materialized (select m.c, coalesce(f.at, m.at) as at from c{n} m left join (select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as at from ({means}) group by c) f on f.c = m.c)")
    last = elkan.ROUNDS
    return f"""with {", ".join(parts)}
select v.vec_id, cast(near.c as int) as cluster, near.d as distance, cast(sum(near.d) over (partition by near.c) as bigint) as cluster_inertia,
       cast(sum(near.d) over () as bigint) as inertia, sha256(array_to_string(m.at, ',')) as centroid_sha256
from a{last} join v using (k) join c{last} m on m.c = near.c"""


def op12_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inner_products.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0).select("query_id", "rank", "vec_id", "score")


OP12_SQL = f"""with {VECTORS_SQL % ""},
s as (select q.k as query, q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) as bigint) as score
      from v q join v c on c.k <> q.k and len(c.x) = len(q.x) where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query order by score desc, vec_id nulls last) as rank from s)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 10
"""


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The table of the CRC comes from its polynomial; a feature's CRC folds its UTF-8 bytes.
OP13_SQL = rf"""
with recursive steps(i, c, n) as (
  select i, i, 0 from range(256) g(i)
  union all select i, case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end, n + 1 from steps where n < 8),
crc as materialized (select list(c order by i) as t from steps where n = 8),
texts as (select 'd' as kind, doc_id as id, row_number() over () as k, coalesce(text, '') as text from documents
          union all select 'b', item_id, row_number() over (), coalesce(text, '') from benchmark),
w as materialized (select kind, id, k, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from texts),
f as materialized (
  select kind, k, unnest(words) as f from w
  union all select kind, k, unnest(list_transform(generate_series(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1])) from w where len(words) > 1),
h as (select f, hex(encode(f)) as x from (select distinct f from f)),
b as materialized (
  select f, xor(list_reduce(list_prepend(4294967295, list_transform(generate_series(1, len(x), 2), lambda i: cast('0x' || x[i:i + 1] as bigint))), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % {resampling.BUCKETS} as b
  from h, crc),
fb as materialized (select kind, k, b from f join b using (f)),
n as (select b, count(*) filter (kind = 'd') as s, count(*) filter (kind = 'b') as t from fb group by b),
z as (select sum(s) as s, sum(t) as t from n),
g as (select b, floor(1000 * ln((cast(n.t + 1 as double) * (z.s + {resampling.BUCKETS})) / (cast(n.s + 1 as double) * (z.t + {resampling.BUCKETS})))) as gain from n, z),
m as (select k, count(*) as n_features, cast(floor(sum(gain) / count(*)) as bigint) as weight from fb join g using (b) where kind = 'd' group by k),
d as (
  select id as doc_id, w.k, len(words) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
         coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || left(sha256('{resampling.SEED}' || id), 8) as bigint) + 0.5) / 4294967296::double))) as bigint) as score
  from w left join m using (k) where kind = 'd'),
r as (select k, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n from d where n_words >= {resampling.LEAST_WORDS})
select doc_id, cast(n_features as bigint) as n_features, weight, score, case when rank <= {resampling.PERCENT} * n // 100 then rank end as rank
from d left join r using (k)
"""

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_order_minhash": op2_order_minhash,
    "op3_main_text": op3_main_text,
    "op4_line_dedup": op4_line_dedup,
    "op5_merkle_audit": op5_merkle_audit,
    "op6_bpe": op6_bpe,
    "op7_decontaminate": op7_decontaminate,
    "op8_chat": op8_chat,
    "op9_url_filter": op9_url_filter,
    "op10_toxicity": op10_toxicity,
    "op11_elkan_clusters": op11_elkan_clusters,
    "op12_inner_products": op12_inner_products,
    "op13_resample": op13_resample,
    "quality_ablations": quality_ablations,
}
ORACLES = {"op1_quality_rules": OP1_SQL, "op5_merkle_audit": OP5_SQL, "op8_chat": OP8_SQL, "op11_elkan_clusters": _clusters_sql(), "op12_inner_products": OP12_SQL, "op13_resample": OP13_SQL, "quality_ablations": _ablations_sql()}
