"""The registered queries of this subpackage: one for each operator, over its whole table."""

from pyspark.sql import functions as F

from thermotrack.llm.bpe import decode, encode
from thermotrack.llm.chat import format_conversations, learned_text, parsed_turns
from thermotrack.llm.codes import books_digest, vector_codes, with_group_error
from thermotrack.llm.decontamination import contamination
from thermotrack.llm.fingerprints import edited_likeness
from thermotrack.llm.lines import line_classes
from thermotrack.llm.minhash import near_duplicate_groups
from thermotrack.llm.mixing import mix_sources
from thermotrack.llm.neighbours import nearest
from thermotrack.llm.planes import plane_kmeans
from thermotrack.llm.quality import quality_of
from thermotrack.llm.substrings import remove_repeats
from thermotrack.llm.toxicity import toxicity_of


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TRAP = "\\### Assistant: </turn> ok"


def op1_chat_format(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.createDataFrame([(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)], turns.schema)
    formatted = format_conversations(turns.union(trap))
    read = formatted.withColumn("turns", parsed_turns(F.col("formatted"))).withColumn(
        "loss", learned_text(F.col("segments")))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))


def op5_bpe(spark, sf_dir):
    path = vocabulary()
    encoded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text")
    decoded = decode(encoded, path)
    return decoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_substring_dedup(spark, sf_dir):
    kept = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_fingerprints(spark, sf_dir):
    return edited_likeness(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


def op7_minhash_groups(spark, sf_dir):
    groups = near_duplicate_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op2_line_dedup(spark, sf_dir):
    lines = line_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return lines.drop("text_hash")


def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity_of(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", F.col("toxicity").alias("score"),
                         F.col("is_toxic").cast("int").alias("predicted"),
                         F.size("toxic_spans").alias("n_toxic_sentences"))


def vocabulary():
    """Path of the public vocabulary file, the same on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op4_mix_sources(spark, sf_dir):
    mixed = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_of(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", F.col("quality").alias("score"),
                         F.col("is_good").cast("int").alias("predicted"))


def op11_vector_codes(spark, sf_dir):
    coded, books = vector_codes(table(spark, sf_dir, "embeddings"), keep=["label"])
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return with_group_error(coded).select("vec_id", code.alias("code"), "error", "label_error",
                                          F.lit(books_digest(books)).alias("codebooks_sha256"))


def op12_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op13_centroids(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    components = F.array_join(F.col("centroid").cast("array<string>"), ",")
    return plane_kmeans(vectors).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                                        F.sha2(components, 256).alias("centroid_sha256"))


def queries():
    return {f.__name__: f for f in (
        op1_chat_format, op2_line_dedup, op3_toxicity, op4_mix_sources, op5_bpe, op6_neighbours, op7_minhash_groups,
        op8_substring_dedup, op9_fingerprints, op10_quality, op11_vector_codes, op12_decontamination, op13_centroids)}


OP1 = """
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
marked as (
  select *, lag(role) over w is distinct from role as opens, lead(role) over w is distinct from role as closes,
         replace(replace(role, '\\', '\\s'), '<|', '\\l') as r, replace(replace(text, '\\', '\\s'), '<|', '\\l') as t
  from turns window w as (partition by conv_id order by turn nulls first, role, text))
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(case when opens then 8 + length(r) + 8 else 8 end + length(t) + case when closes then 7 else 0 end)::bigint
         as formatted_chars
from marked group by conv_id
"""

OP4 = """
with sizes as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, 'null')), 1, 15))::bigint as hash
  from documents),
sources as (
  select source, sum(size)::bigint as source_size,
         ((row_number() over (order by source nulls last) - 1) % 3 + 1)::bigint as weight
  from sizes group by source),
levels as (
  select *, source_size * 3 as cap,
         ((sum(source_size) over ())::bigint
          - coalesce((sum(source_size * 3) over (order by source_size * 3 / weight, source nulls last
                      rows between unbounded preceding and 1 preceding))::bigint, 0))
         / (sum(weight) over (order by source_size * 3 / weight, source nulls last
                      rows between current row and unbounded following))::bigint as level
  from sources),
targets as (
  select source, source_size,
         least(cap::double, coalesce((select max(level) from levels l where l.level * l.weight <= l.cap
               and not exists (select 1 from levels e where e.level * e.weight <= e.cap
                               and (e.cap / e.weight, coalesce(e.source, chr(1114111))) < (l.cap / l.weight, coalesce(l.source, chr(1114111))))) * weight,
               cap::double)) as target
  from levels),
ordered as (
  select s.doc_id, s.size, t.source_size, t.target, s.hash,
         case when t.source_size > 0 then floor(t.target / t.source_size)::bigint else 0 end as full_times,
         sum(s.size) over (partition by s.source order by s.hash) as until,
         s.source
  from sizes s join targets t on s.source is not distinct from t.source),
edges as (
  select source, min(hash) filter (until > target - full_times * source_size) as passing, max(hash) as top
  from ordered group by source),
marked as (
  select o.*, coalesce(e.passing, e.top) as threshold
  from ordered o join edges e on o.source is not distinct from e.source),
lasts as (
  select source, any_value(until)::bigint as until, sum(size)::bigint as words
  from marked where hash = threshold group by source)
select m.doc_id, m.size, m.source_size, m.target,
       (m.size * least(m.full_times + case when m.hash < m.threshold then 1
          when m.hash = m.threshold and 2 * (m.target - m.full_times * m.source_size - (l.until - l.words)) >= l.words
          then 1 else 0 end, 3))::bigint as taken
from marked m join lasts l on m.source is not distinct from l.source
"""


def _square(a, b):
    """Squared distance of two lists of whole numbers: exact in doubles below 2**53."""
    a, b = f"{a}::double[]", f"{b}::double[]"
    return f"(list_inner_product({a}, {a}) + list_inner_product({b}, {b}) - 2 * list_inner_product({a}, {b}))::bigint"


def _op11():
    steps = ["""kept as materialized (
  select vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
             """parts as materialized (
  select vec_id, label, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] as x from kept, range(4) t(p))""",
             """book0 as materialized (
  select p, row_number() over (partition by p order by vec_id) - 1 as e, x as c from parts
  where vec_id in (select vec_id from kept order by vec_id limit 256))"""]
    for n in range(5):
        steps.append(f"""near{n} as materialized (
  select vec_id, any_value(label) as label, parts.p, any_value(x) as x, min(row({_square("x", "c")}, e)) as best
  from parts join book{n} b on parts.p = b.p group by vec_id, parts.p)""")
        if n < 4:
            steps.append(f"""book{n + 1} as materialized (
  select b.p, b.e, coalesce(m.c, b.c) as c from book{n} b left join (
    select p, e, list(mean order by i) as c from (
      select p, best[2] as e, i, floor(sum(x[i]) / count(*))::bigint as mean
      from near{n}, (select unnest(range(1, (select max(len(x)) + 1 from parts))) as i) group by p, best[2], i) group by p, e) m
  on b.p = m.p and b.e = m.e)""")
    steps.append("""coded as (
  select vec_id, any_value(label) as label, string_agg(printf('%02x', best[2]), '' order by p) as code,
         sum(best[1])::bigint as error from near4 group by vec_id)""")
    return "with " + ",\n".join(steps) + """
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
       (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) from book4) as codebooks_sha256
from coded
"""


OP12 = """
with docs as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
items as (
  select item_id::varchar as item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
windows as (
  select distinct item, least(len(w), 10) as n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as window
  from (select *, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from items where len(w) > 0)),
places as (
  select r, n, i, array_to_string(w[i : i + n - 1], ' ') as window
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, (select distinct n from windows))),
found as (select r, places.n, i, item from places join windows on places.n = windows.n and places.window = windows.window),
hits as (select r, count(distinct k) as n_hit from (select r, unnest(range(i, i + n)) as k from found) group by r),
named as (select r, count(*) as n_items, string_agg(item, ',' order by item) as ids
          from (select distinct r, item from found) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hits on docs.r = hits.r left join named on docs.r = named.r
"""


def _op13():
    steps = ["""kept as materialized (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as x from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
             """mid0 as materialized (
  select row_number() over (order by sha256('1:' || vec_id)) - 1 as e, x as c from kept
  order by sha256('1:' || vec_id) limit 16)"""]
    for n in range(4):
        steps.append(f"""near{n} as materialized (
  select vec_id, any_value(x) as x, min(row({_square("x", "c")}, e)) as best from kept, mid{n} group by vec_id)""")
        if n < 3:
            steps.append(f"""mid{n + 1} as materialized (
  select b.e, coalesce(m.c, b.c) as c from mid{n} b left join (
    select e, list(mean order by i) as c from (
      select best[2] as e, i, floor(sum(x[i]) / count(*))::bigint as mean from near{n}, range(1, 65) t(i) group by best[2], i)
    group by e) m on b.e = m.e)""")
    return "with " + ",\n".join(steps) + """
select vec_id, best[2]::integer as cluster, best[1]::bigint as distance,
       (sum(best[1]) over (partition by best[2]))::bigint as cluster_inertia, (sum(best[1]) over ())::bigint as inertia,
       sha256(array_to_string(c, ',')) as centroid_sha256
from near3 join mid3 on best[2] = mid3.e
"""


def oracle_sql():
    return {"op1_chat_format": OP1, "op4_mix_sources": OP4, "op11_vector_codes": _op11(),
            "op12_decontamination": OP12, "op13_centroids": _op13()}
