"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, conversation_repair, decontamination, filter_audit, langid, ngram_join, packing, pii, quality_classifier, sentencepiece_codec, toxicity
from .common import read
from .quality_rules import base_failed, quality_rules, statistics
from .sharding import shard


def _fold(of: int) -> Column:
    """Remainder of the checksum of the id, which deals documents out to folds."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text: number and hash of its ids, and whether it came back whole.

    A text that holds U+2581 comes back with a space there, as the format prescribes.
    """
    checksum = F.crc32(F.replace(F.col("text"), F.lit("▁"), F.lit(" ")).cast("binary"))
    docs = read(spark, sf_dir, "documents").select(F.struct("doc_id", checksum.alias("text_crc32")).alias("doc_id"), "text")
    ids = sentencepiece_codec.encode(docs).select(
        "doc_id.doc_id", "doc_id.text_crc32", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), "ids"
    )
    decoded_crc32 = F.crc32(F.col("text").cast("binary"))
    back = sentencepiece_codec.decode(ids).withColumn("decoded_crc32", decoded_crc32)
    return back.select("doc_id", "n_ids", "ids_hash", "decoded_crc32", F.col("decoded_crc32").eqNullSafe(F.col("text_crc32")).alias("round_trip"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    network = langid.train(docs.where(_fold(5) != 0))
    return langid.identify(docs, network).select("doc_id", (_fold(5) == 0).alias("held_out"), "lang_pred", "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, read(spark, sf_dir, "labels").where(_fold(4) != 2))
    return toxicity.score(docs, model).select("doc_id", (_fold(4) == 2).alias("held_out"), "score", "predicted")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.near_duplicates(read(spark, sf_dir, "embeddings")).drop("audited_recall")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymize(docs, pii.stored_keys(spark))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.train(docs, read(spark, sf_dir, "labels")))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    found = conversation_repair.repair_report(conversation_repair.damage(rows), rows.select(F.col("conv_id").alias("conv")))
    return found.withColumnRenamed("conv", "conv_id")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = filter_audit.failures(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return filter_audit.audit(flagged).where("part is not null")


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics and the base rule of op4, which SQL can state."""
    rows = read(spark, sf_dir, "documents").select("doc_id", statistics(F.col("text")).alias("s"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.select("doc_id", *[F.col("s")[c].alias(c) for c in names], base_failed(F.col("s")).alias("base_failed"))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_langid": op2_langid,
    "op3_toxicity": op3_toxicity,
    "op4_quality_rules": op4_quality_rules,
    "op5_packing": op5_packing,
    "op6_near_vectors": op6_near_vectors,
    "op7_ngram_join": op7_ngram_join,
    "op8_pii": op8_pii,
    "op9_sharding": op9_sharding,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_filter_audit": op12_filter_audit,
    "op13_decontamination": op13_decontamination,
    "quality_statistics": quality_statistics,
}

_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_REACH = """reach as (select id, id r from nodes union select e.y, reach.r from reach join edges e on e.x = reach.id),
component as (select id, min(r) component_id from reach group by id)"""

#: DuckDB SQL where it can express the operator; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op6_near_vectors": f"""with recursive v as (select vec_id, label, embedding::double[] e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
edges as (select a.vec_id x, b.vec_id y from v a join v b on a.label = b.label and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.98),
nodes as (select vec_id id from embeddings), {_REACH}
select id vec_id, (select count(*) from edges where x = id) n_links, component_id, id = component_id kept from component""",
    "op7_ngram_join": f"""with recursive w as (select doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ws from documents),
sets as (select doc_id, list_distinct(case when len(ws) >= 5 then list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 4], ' '))
  when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) g from w),
grams as (select doc_id, len(g) n, unnest(g) s from sets),
shared as (select a.doc_id x, b.doc_id y, a.n na, b.n nb, count(*) o from grams a join grams b on a.s = b.s and a.doc_id <> b.doc_id group by all),
edges as (select x, y from shared where 100 * o >= 75 * (na + nb - o)),
nodes as (select doc_id id from documents), {_REACH}
select doc_id, len(g) n_shingles, component_id from sets join component on id = doc_id""",
    "op11_conversation_repair": r"""with recursive k as (select row_number() over () rid, conv_id, turn, coalesce(role, ' ') ro, coalesce(text, ' ') tx, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') s from conversations),
crc as (select *, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(s, ''), lambda c: [ord(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, b: case when b >= 0 then xor(c, b) when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end)) % 20 h from k),
hurt as (select conv_id, turn, case when h = 4 then 'user' else ro end ro, case when h = 1 then '' when h = 2 then regexp_replace(tx, '[.!?]', '', 'g') else tx end tx, unnest(range(case when h = 3 then 2 else 1 end)) c from crc where h <> 0),
ranked as (select conv_id, turn, ro, tx, row_number() over (partition by conv_id order by turn nulls first, ro, md5(tx)) n, regexp_extract(tx, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) z from hurt),
coded as (select *, coalesce(nullif(regexp_extract(ro, '^[sua]'), ''), 'x') i, case when z = '' then 'b' when row_number() over (partition by conv_id, ro, tx order by n) > 1 then 'd' when z not in ('.', '!', '?') then 't' else 'o' end f from ranked),
sig as (select conv_id, string_agg(i || f, '' order by n) g, max(turn) - min(turn) + 1 - count(distinct turn) gaps from coded group by conv_id),
ins as (select * from (values (0, '', 0), (0, 'I', 2), (0, 'II', 3), (0, 'III', 2), (1, '', 1), (1, 'I', 2), (1, 'II', 3), (1, 'III', 2), (2, '', 2), (2, 'I', 3), (2, 'II', 2), (2, 'III', 3), (3, '', 3), (3, 'I', 2), (3, 'II', 3), (3, 'III', 2)) t(q, e, q1)),
ed as (select i, f, q1, q2, e, c + case when f = 't' and e <> 'D' then 5 else 0 end c from
  (select i, f, q1, q1 q2, 'D' e, 2 c from (values ('s'), ('u'), ('a'), ('x')) a(i), (values ('b'), ('d'), ('t'), ('o')) b(f), range(4) r(q1)
   union all select i, f, q1, case q1 when 2 then 3 else 2 end, 'R', 1 from (values ('s'), ('u'), ('a'), ('x')) a(i), (values ('t'), ('o')) b(f), range(4) r(q1)
   union all select i, f, q1, q2, 'K', 0 from (values ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)) a(i, q1, q2), (values ('t'), ('o')) b(f))),
walk as (select distinct g, 0 p, 0::bigint q, {'c': 0::bigint, 'e': ''} b from sig
  union all
  select g, p + 1, q2::bigint, min({'c': b.c + 5 * length(ins.e) + ed.c, 'e': b.e || ins.e || ed.e}) from walk join ins on ins.q = walk.q join ed on ed.q1 = ins.q1 and ed.i || ed.f = substr(g, 2 * p + 1, 2) where 2 * p < length(g) group by all),
best as (select g, min({'c': b.c + 5 * length(ins.e), 'e': b.e || ins.e}) b from walk join ins on ins.q = walk.q where 2 * p = length(g) and ins.q1 in (0, 3) group by g),
plan as (select conv_id, unnest(range(1, length(b.e) + 1)) p, b.e e from sig join best using (g)),
put as (select conv_id, p, substr(e, p, 1) x, length(replace(substr(e, 1, p), 'I', '')) n, length(replace(substr(e, 1, p - 1), 'D', '')) o from plan),
made as (select put.*, ro, tx, max(case when x = 'K' and i = 's' then 1 else 0 end) over (partition by put.conv_id) sys from put left join coded on coded.conv_id is not distinct from put.conv_id and coded.n = put.n and x <> 'I'),
sha as (select conv_id, sha256(string_agg(case when x = 'K' then ro when (o - sys) % 2 = 0 then 'user' else 'assistant' end || ':' || coalesce(tx, ''), chr(10) order by p)) h from made where x <> 'D' group by conv_id),
ids as (select distinct conv_id from conversations)
select ids.conv_id, coalesce(gaps, 0) gaps, length(g) - length(replace(g, 'b', '')) blank, length(g) - length(replace(g, 'd', '')) duplicate, length(g) - length(replace(g, 't', '')) truncated,
  len(list_filter(range(1, length(g) // 2), lambda k: substr(g, 2 * k - 1, 1) || substr(g, 2 * k + 1, 1) not in ('su', 'ua', 'au'))) illegal, b.c as cost, b.e as audit, coalesce(h, sha256('')) repaired_sha256
from ids left join sig s on s.conv_id is not distinct from ids.conv_id left join best using (g) left join sha on sha.conv_id is not distinct from ids.conv_id""",
    "op12_filter_audit": f"""with w as (select doc_id, coalesce(source, '') part, coalesce(text, '') t, {_WORDS.format("coalesce(text, '')")} ws from documents),
lab as (select doc_id, max(quality = 1) good, max(toxic = 1) toxic from labels group by doc_id),
f as (select part, len(ws) < 200 a, 100 * len(list_distinct(ws)) < 50 * len(ws) b, 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t) c, regexp_matches(t, '[#$%&*|]') d,
  coalesce(doc_id > min(doc_id) over (partition by t), false) e, coalesce(good, false) good, coalesce(toxic, false) toxic from w left join lab using (doc_id)),
cell as (select part, [a, b, c, d, e] fails, count(*) n, count(*) filter (good) good, count(*) filter (toxic) toxic from f group by all),
letters as (select * from (values (1, 'A'), (2, 'B'), (3, 'C'), (4, 'D'), (5, 'E')) t(k, l)),
orders as (select o.l || p.l || q.l || r.l || s.l filter_order, [o.k, p.k, q.k, r.k, s.k] ks from letters o, letters p, letters q, letters r, letters s
  where len(list_distinct([o.k, p.k, q.k, r.k, s.k])) = 5),
step as (select filter_order, cast(i as int) step, ks[i] own, ks[1:i - 1] earlier, list_filter([1, 2, 3, 4, 5], lambda k: k <> ks[i]) others from orders, range(1, 6) t(i)),
run as (select part, filter_order, step, own, fails[own] own_fails, len(list_filter(earlier, lambda k: fails[k])) > 0 gone, len(list_filter(others, lambda k: fails[k])) > 0 other_fails, n, good, toxic from cell, step),
out as (select part, filter_order, step, own, cast(coalesce(sum(n) filter (not gone and not own_fails), 0) as bigint) kept, cast(coalesce(sum(n) filter (not gone and own_fails), 0) as bigint) removed,
  cast(coalesce(sum(n) filter (gone and own_fails), 0) as bigint) redundant, cast(coalesce(sum(n) filter (own_fails and not other_fails), 0) as bigint) unique_fails,
  cast(coalesce(sum(good) filter (not gone and own_fails), 0) as bigint) good_lost, cast(coalesce(sum(toxic) filter (not gone and own_fails), 0) as bigint) toxic_lost from run group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, cast(sum(removed) over (partition by part, own) as bigint) shapley from out""",
    "op13_decontamination": r"""with d as (select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
i as (select cast(item_id as varchar) item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from benchmark),
win as (select distinct item, m, array_to_string(ws[k:k + m - 1], ' ') g from (select item, ws, least(len(ws), 10) m, unnest(generate_series(1, greatest(len(ws) - 9, 1))) k from i where len(ws) > 0)),
place as (select r, m, k, array_to_string(ws[k:k + m - 1], ' ') g from (select r, ws, m, unnest(generate_series(1, len(ws) - m + 1)) k from d, (select distinct m from win))),
hits as (select r, place.m, k, item from place join win using (m, g)),
word as (select r, count(distinct k + o) n_hit from hits, range(10) t(o) where o < m group by r),
ids as (select r, count(*) n_items, string_agg(item, ',' order by item) s from (select distinct r, item from hits where item is not null) group by r)
select doc_id, cast(len(ws) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join word using (r) left join ids using (r)""",
    "quality_statistics": f"""with w as (select doc_id, {_WORDS.format("coalesce(text, '')")} ws from documents),
windows as (select doc_id, i, array_to_string(ws[i:i + 4], ' ') g from (select doc_id, ws, unnest(generate_series(1, len(ws) - 4)) i from w)),
twice as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) c from windows) where c > 1),
covered as (select doc_id, count(distinct i + k) n from twice, range(5) r(k) group by doc_id),
line as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) l from documents),
again as (select doc_id, sum(c - 1) n from (select doc_id, l, count(*) c from line where regexp_matches(l, '[^\x20\x09-\x0D]') group by all) group by doc_id),
base as (select w.doc_id, len(ws) n_words, length(array_to_string(ws, '')) word_chars, length(regexp_replace(array_to_string(ws, ''), '[^#*$%&|<>]+', '', 'g')) n_symbols,
  cast(coalesce(again.n, 0) as bigint) n_dup_lines, coalesce(covered.n, 0) n_repeat_words from w left join covered using (doc_id) left join again using (doc_id))
select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed from base""",
}
