"""One query per operator group, over whole tables, and DuckDB SQL that gives the same rows.

The SQL is written on its own, from the rules and not from the plans.  Doubles are rounded on
both sides; times are text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import fields, scalars
from ..operators import knn, metrics, paging, pixels, repository, training
from ..sources import files, images, scratch, tables
from ..streaming import profiles
from . import debugging, fixtures, ocr, reports, script

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def ts(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# --- SQL of the fixtures ---

_CENTS = "cast(round({} * 100) as bigint)"
_MONEY = "concat({0} // 100, '.', lpad(cast({0} % 100 as varchar), 2, '0'))"
INVOICES = f"""amounts as (
  select o_orderkey, o_custkey, o_orderdate, {_CENTS.format('o_totalprice')} v from orders),
sums as (select *, v * 19 // 100 i from amounts),
written as (
  select o_orderkey doc_id, o_orderkey % 7 k, c_name, cast(o_custkey + 900000000 as varchar) n, strftime(o_orderdate, '%Y-%m-%d') d,
         {_MONEY.format('i')} iva, {_MONEY.format('v')} valor, {_MONEY.format('(v + i)')} total, i, v
  from sums join customer on c_custkey = o_custkey),
lists as (
  select *, list_filter([
    case when k <> 6 then concat('Proveedor: ', c_name) end,
    case when k in (1, 6) then n else concat('NIT ', n) end,
    case when k = 2 then null when k = 6 then d else concat('Fecha ', d) end,
    case when k in (5, 6) then iva else concat('IVA ', iva) end,
    case when k = 6 then valor else concat('Valor ', valor) end,
    case when k in (4, 6) then null when k = 3 then concat('Total a pagar por el cliente ', total) else concat('Total ', total) end
  ], lambda x: x is not null) l from written),
inv as (select *, array_to_string(l, chr(10)) t from lists)"""


def _found(field: str, pattern: str, words: str, source: str = "inv") -> str:
    """CTE `field`: (doc_id, value, confidence, start) by the three grades."""
    key = rf"(?i)\b(?:{words})\b"
    return rf"""{field}_0 as (
  select doc_id, t, regexp_extract_all(t, '{pattern}') m, string_split_regex(t, '{pattern}') g,
         regexp_extract_all(t, '{key}') km, string_split_regex(t, '{key}') kg from {source}),
{field}_1 as (
  select doc_id,
    list_transform(m, lambda x, i: {{'v': x, 's': length(coalesce(array_to_string(g[1:i], ''), '')) + length(coalesce(array_to_string(m[1:i-1], ''), ''))}}) ms,
    list_transform(km, lambda x, i: length(coalesce(array_to_string(kg[1:i], ''), '')) + length(coalesce(array_to_string(km[1:i], ''), ''))) ends
  from {field}_0),
{field}_2 as (
  select doc_id, ms, ends,
    list_filter(ms, lambda x: len(list_filter(ends, lambda e: x.s >= e and x.s - e <= 15)) > 0)[1] adj,
    list_sort(flatten(list_transform(ms, lambda x, i: list_transform(ends, lambda e: {{'d': abs(x.s - e), 'i': i}}))))[1].i near
  from {field}_1),
{field} as (
  select doc_id,
    case when adj is not null then adj.v when near is not null then ms[near].v else ms[1].v end as val,
    case when adj is not null then 0.95::double when near is not null then 0.7::double when len(ms) > 0 then 0.5::double else 0.0::double end as conf,
    case when adj is not null then adj.s when near is not null then ms[near].s else ms[1].s end as start
  from {field}_2)"""


_NIT = _found("nit", r"\d{1,3}\.\d{3}\.\d{3}-\d{1}|\d{9,11}", r"NIT|N\.I\.T")
_FECHA = _found("fecha", r"\d{4}-\d{2}-\d{2}|\d{1,2}[/-]\d{1,2}[/-]\d{4}", "Fecha|Emisión|Emision|Date")
_AMOUNT = r"\d+[.,]\d{2}"
_IVA, _VALOR, _TOTAL = (_found(f, _AMOUNT, k) for f, k in (("iva", "IVA|Impuesto"), ("valor", "Valor|Subtotal"), ("total", "Total")))
_PROVEEDOR = r"""named as (
  select doc_id, l, list_filter(list_transform(l, lambda x: trim(regexp_extract(x, '(?i)\bProveedor\b\s*[:.]?\s*(.*)$', 1))), lambda x: x <> '')[1] p,
         list_filter(l, lambda x: regexp_matches(x, '[A-Za-z]{3,}'))[1] w from inv),
proveedor as (select doc_id, coalesce(p, w) val, case when p is not null then 0.9::double when w is not null then 0.5::double else 0.0::double end conf from named)"""
ALL_FIELDS = ",\n".join((INVOICES, _PROVEEDOR, _NIT, _FECHA, _IVA, _VALOR, _TOTAL))
LONG_FIELDS = """long as (
  select doc_id, 0 position, 'proveedor' field, val value_str, null::double value_num, conf from proveedor
  union all select doc_id, 1, 'nit', val, null, conf from nit union all select doc_id, 2, 'fecha', val, null, conf from fecha
  union all select doc_id, 3, 'iva', null, cast(replace(val, ',', '.') as double), conf from iva
  union all select doc_id, 4, 'valor', null, cast(replace(val, ',', '.') as double), conf from valor
  union all select doc_id, 5, 'total', null, cast(replace(val, ',', '.') as double), conf from total),
truth as (
  select doc_id, 'proveedor' field, c_name ts, null::double tn from written union all select doc_id, 'nit', n, null from written
  union all select doc_id, 'fecha', d, null from written union all select doc_id, 'iva', null, i / 100 from written
  union all select doc_id, 'valor', null, v / 100 from written union all select doc_id, 'total', null, (v + i) / 100 from written),
judged as (
  select l.*, (value_str is not null or value_num is not null) found,
         coalesce(case when tn is not null then abs(value_num - tn) < 0.005 else value_str = ts end, false) hit
  from long l join truth using (doc_id, field))"""

PIXELS = """px as (
  select img, (i - 1) % 8 x, (i - 1) // 8 y, cast(least(255, greatest(0, floor((e + 1) * 127.5))) as int) v
  from (select vec_id img, unnest(embedding)::double e, generate_subscripts(embedding, 1) i from embeddings))"""
BINARY = PIXELS + ", bw as (select img, x, y, case when v >= 128 then 255 else 0 end v from px)"
ROWS = BINARY + ", rows_ as (select img, y, count(*) filter (v = 255) n from bw group by all)"
LINES = ROWS + """, isl as (select *, y - row_number() over (partition by img order by y) g from rows_ where n >= 3),
runs as (select img, g, min(y) low, max(y) high from isl group by all),
lines_ as (select img, row_number() over (partition by img order by low) - 1 line, low, high from runs)"""
_COMPONENTS = """seed as (select img, x, y, y * 8 + x id from bw where v = 255),
reach as (
  select img, id, id to_id from seed
  union
  select r.img, r.id, b.id from reach r join seed a on a.img = r.img and a.id = r.to_id
  join seed b on b.img = a.img and abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1),
least_ as (select img, id, min(to_id) root from reach group by all),
parts as (select s.img, s.x, s.y, dense_rank() over (partition by s.img order by root) - 1 component from seed s join least_ l using (img, id))"""
COMPONENTS = BINARY + ", " + _COMPONENTS
BOXED = LINES + ", " + _COMPONENTS + """, boxes as (
  select img, component, min(x) x0, max(x) x1, min(y) y0, max(y) y1, count(*) n from parts group by all),
overlap as (select l.img, line, low, high, component, x0, x1, y0, y1 from lines_ l left join boxes b on b.img = l.img and y0 <= high and y1 >= low)"""

DOCS = """docs as (
  select o_orderkey id, o_custkey owner_id, 'invoice_es' document_type,
         case o_orderstatus when 'O' then 'uploaded' when 'P' then 'processed' else 'validated' end status, o_orderdate created_at from orders)"""
RESULTS = """res as (
  select l_orderkey document_id, l_linenumber line_no, l_partkey part, cast(1 - l_discount as decimal(4,3)) confidence, l_shipdate created_at,
         'Supplier#' || lpad(cast(l_suppkey as varchar), 9, '0') proveedor, cast(l_extendedprice as decimal(18,2)) total from lineitem)"""
LATEST = RESULTS + """, lastres as (
  select * from res qualify row_number() over (partition by document_id order by created_at desc, line_no desc, part desc) = 1)"""
VALIDATIONS = """cut as (
  select *, cast(round(l_extendedprice * 100) as bigint) c, cast(round(l_tax * 100) as bigint) x, l_returnflag = 'R' ed from lineitem where l_returnflag in ('A', 'R')),
val as (
  select l_orderkey document_id, l_linenumber line_no, l_partkey part, l_suppkey validated_by, l_shipdate validated_at,
         ed and (x <> 0 or l_linenumber = 3) manually_edited, 'S' || l_suppkey proveedor, cast(l_partkey as varchar) nit,
         case when ed and l_linenumber = 3 then '"' || l_partkey || '"' else cast(l_partkey as varchar) end nit_after,
         cast(l_linenumber as varchar) iva, c total, case when ed then c + x else c end total_after
  from cut)"""
LAST_VALIDATION = VALIDATIONS + """, lastval as (
  select * from val qualify row_number() over (partition by document_id order by validated_at desc, line_no desc, part desc) = 1)"""
PROFILES = """prof as (
  select c_custkey id, lower(replace(c_name, '#', '.')) || '@example.com' email, case when c_custkey % 100 = 0 then 'ADMIN' else 'USER' end as role from customer)"""
_T = "strftime({}, '%Y-%m-%d %H:%M:%S')"

NEAR = """q as (select vec_id, label, embedding::double[] e from embeddings where vec_id % 5 = 0),
m as (select vec_id, label, embedding::double[] e from embeddings where vec_id % 5 <> 0),
dist as (select q.vec_id q, m.vec_id sample_idx, cast(m.label as varchar) label, list_distance(q.e, m.e) distance from q cross join m),
near as (select *, row_number() over (partition by q order by distance, sample_idx) rank from dist qualify rank <= 3)"""
VOTES = NEAR + """, votes as (select q, label, sum(1 / (distance + 0.001)) w, min(rank) f from near group by all),
shares as (select q, label, w / sum(w) over (partition by q) share, row_number() over (partition by q order by w desc, f) place from votes),
pairs as (select s.q, cast(e.label as varchar) expected, s.label predicted, share from shares s join embeddings e on e.vec_id = s.q where place = 1)"""


# --- field extraction ---


def _extracted(spark: SparkSession, d: str) -> DataFrame:
    return fields.extract_fields(fixtures.invoices(spark, d))


@query(f"""with {ALL_FIELDS}
select p.doc_id, p.val proveedor, n.val nit, f.val fecha, cast(replace(i.val, ',', '.') as double) iva, cast(replace(v.val, ',', '.') as double) valor,
       cast(replace(t.val, ',', '.') as double) total, p.conf proveedor_c, n.conf nit_c, f.conf fecha_c, i.conf iva_c, v.conf valor_c, t.conf total_c
from proveedor p join nit n using (doc_id) join fecha f using (doc_id) join iva i using (doc_id) join valor v using (doc_id) join total t using (doc_id)""")
def fields_extract(spark: SparkSession, d: str) -> DataFrame:
    names = config.VALIDATION_FIELDS
    return _extracted(spark, d).select("doc_id", *[F.col(f)["value"].alias(f) for f in names], *[F.col(f)["confidence"].alias(f"{f}_c") for f in names])


@query(f"with {ALL_FIELDS}, {LONG_FIELDS} select field, conf confidence, count(*) n from long group by all")
def fields_best_match_tiers(spark: SparkSession, d: str) -> DataFrame:
    return fields.long_fields(_extracted(spark, d)).groupBy("field", "confidence").agg(F.count("*").alias("n"))


@query("""with c as (select conv_id doc_id, turn, coalesce(text, '') t from conversations where conv_id is not null),
p as (select *, regexp_extract(t, '(?i)\\b(?:Proveedor|Emisor|Razón Social|Razon Social|Señor|Senor)\\b\\s*[:.]?\\s*(.*)$', 1) rest from c),
ids as (select distinct doc_id from c),
named as (select doc_id, min_by(trim(rest), turn) v from p where trim(rest) <> '' group by 1),
word as (select doc_id, min_by(t, turn) v from c where regexp_matches(t, '[A-Za-z]{3,}') group by 1)
select doc_id, coalesce(n.v, w.v) proveedor, case when n.v is not null then 0.9::double when w.v is not null then 0.5::double else 0.0::double end confidence
from ids left join named n using (doc_id) left join word w using (doc_id)""")
def fields_proveedor(spark: SparkSession, d: str) -> DataFrame:
    c = fixtures.conversation_lines(spark, d)
    f = fields.proveedor_field(F.col("lines"))
    return c.select("doc_id", f.alias("p")).select("doc_id", F.col("p.value").alias("proveedor"), F.col("p.confidence").alias("confidence"))


@query(f"""with {INVOICES}, {_TOTAL},
ends as (select doc_id, unnest(list_transform(l, lambda x, i: length(array_to_string(l[1:i], '')) + i - 1)) e, generate_subscripts(l, 1) i from inv)
select t.doc_id, case when start is not null then cast(min((i - 1) * 25) filter (e >= start) as int) end as y from total t join ends using (doc_id) group by t.doc_id, start""")
def fields_line_at_index(spark: SparkSession, d: str) -> DataFrame:
    return _extracted(spark, d).select("doc_id", F.col("total.source_region.y").alias("y"))


@query(f"""with {ALL_FIELDS}, {LONG_FIELDS}, c as (
  select field, position, count(*) n, count(*) filter (hit) tp, count(*) filter (found and not hit) fp, count(*) filter (not found) fn, avg(conf) confidence from judged group by all),
m as (select *, tp / n accuracy, case when tp + fp = 0 then 1 else tp / (tp + fp) end p, case when tp + fn = 0 then 1 else tp / (tp + fn) end rc from c)
select position, field, n, tp, fp, fn, round(confidence, 6) confidence, round(accuracy, 6) accuracy, round(p, 6) "precision", round(rc, 6) recall,
       round(case when p + rc = 0 then 0 else 2 * p * rc / (p + rc) end, 6) f1 from m""")
def fields_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.field_metrics(fields.long_fields(_extracted(spark, d)), fixtures.invoice_truth(spark, d))
    return m.select("position", "field", "n", "tp", "fp", "fn", *[r(c).alias(c) for c in ("confidence", "accuracy", "precision", "recall", "f1")])


@query(f"""with {ALL_FIELDS}, {LONG_FIELDS}
select field, case when not found then 'missing' else 'wrong' end error, count(*) frequency from judged where not hit group by all""")
def fields_common_errors(spark: SparkSession, d: str) -> DataFrame:
    return metrics.common_errors(fields.long_fields(_extracted(spark, d)), fixtures.invoice_truth(spark, d))


@query(f"with {RESULTS} select document_id, line_no, part, case when confidence > 0.9 then 'high' when confidence >= 0.75 then 'medium' else 'low' end as level from res")
def confidence_level(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.ocr_results(spark, d).select("document_id", "line_no", "part", scalars.confidence_level(F.col("confidence")).alias("level"))


@query("""with raw as (select o_orderkey id, case o_orderkey % 4 when 0 then ' ' || cast(o_custkey as varchar) || '.5 ' when 1 then '' when 2 then 'x' || o_custkey else cast(o_custkey as varchar) || 'e2' end v,
  case when o_orderkey % 2 = 0 then 'total' else 'nit' end field from orders)
select id, field = 'nit' or trim(v) = '' or try_cast(trim(v) as double) is not null ok, case when field = 'nit' and trim(v) <> '' then trim(v) end value_str,
       case when field = 'total' then try_cast(nullif(trim(v), '') as double) end value_num from raw""")
def parse_field_value(spark: SparkSession, d: str) -> DataFrame:
    key, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    v = F.when(key % 4 == 0, F.concat(F.lit(" "), c, F.lit(".5 "))).when(key % 4 == 1, "").when(key % 4 == 2, F.concat(F.lit("x"), c)).otherwise(F.concat(c, F.lit("e2")))
    rows = fixtures.read(spark, d, "orders").select(key.alias("id"), F.when(key % 2 == 0, "total").otherwise("nit").alias("field"), v.alias("v"))
    return rows.select("id", scalars.parse_field_value(F.col("field"), F.col("v")).alias("p")).select("id", "p.*")


@query("""select o_orderkey id, case o_orderstatus when 'O' then 'Cargado' when 'P' then 'Procesado' else 'Validado' end status, 'Factura' as type, o_orderpriority other from orders""")
def label_lookup(spark: SparkSession, d: str) -> DataFrame:
    o = fixtures.read(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    docs = fixtures.documents(spark, d).join(o, F.col("id") == F.col("o_orderkey"))
    return docs.select("id", scalars.status_label(F.col("status")).alias("status"), scalars.type_label(F.col("document_type")).alias("type"), scalars.status_label(F.col("o_orderpriority")).alias("other"))


@query("select event_id, strftime(ts - interval 5 hour, '%d/%m/%Y, %H:%M') shown from events")
def format_bogota(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.read(spark, d, "events").select("event_id", scalars.local_time(F.col("ts")).alias("shown"))


@query(f"with {RESULTS} select document_id, line_no, part, printf('%.1f%%', cast(confidence as double) * 100) shown from res")
def percent_format(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.ocr_results(spark, d).select("document_id", "line_no", "part", scalars.percent(F.col("confidence").cast("double")).alias("shown"))


@query("""with u as (select o_orderkey id, case when o_orderkey % 3 = 0 then cast(o_orderkey as varchar) else '00000000-0000-0000-0000-' || lpad(cast(o_orderkey as varchar), 12, '0') end s from orders)
select id, regexp_matches(s, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$') ok from u""")
def uuid_filter(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    s = F.when(F.col("o_orderkey") % 3 == 0, k).otherwise(F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(k, 12, "0")))
    return fixtures.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), scalars.is_uuid(s).alias("ok"))


@query("select page_id, case when starts_with(p, '/') and not starts_with(p, '//') then p else '/' end path from (select page_id, regexp_replace(url, '^[a-z]+:', '') p from pages)")
def internal_path(spark: SparkSession, d: str) -> DataFrame:
    p = F.regexp_replace("url", "^[a-z]+:", "")
    return fixtures.read(spark, d, "pages").select("page_id", scalars.internal_path(p).alias("path"))


# --- nearest neighbours and their metrics ---


def _split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = fixtures.descriptors(spark, d)
    return s.where("dataset_partition = 'test'"), s.where("dataset_partition = 'train'")


def _queries(test: DataFrame) -> DataFrame:
    return test.select(F.col("sample_idx").alias("q"), "descriptor")


@query(f"with {NEAR} select q, rank, sample_idx, label, round(distance, 6) distance from near")
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    test, train = _split(spark, d)
    return knn.topk(_queries(test), train).select("q", "rank", "sample_idx", "label", r("distance").alias("distance"))


@query(ORACLE_SQL["knn_topk"])
def knn_pruned(spark: SparkSession, d: str) -> DataFrame:
    """The same neighbours by blocks of few samples, which the triangle inequality rules out."""
    test, train = _split(spark, d)
    return knn.topk(_queries(test), train, block_rows=64).select("q", "rank", "sample_idx", "label", r("distance").alias("distance"))


@query(f"with {VOTES} select q, predicted label, round(share, 6) confidence from pairs")
def knn_vote(spark: SparkSession, d: str) -> DataFrame:
    test, train = _split(spark, d)
    return knn.predict(_queries(test), train).select("q", "label", r("confidence").alias("confidence"))


@query(f"with {VOTES} select q, place, label, round(share, 6) share from shares")
def knn_topn_labels(spark: SparkSession, d: str) -> DataFrame:
    test, train = _split(spark, d)
    return knn.predict_blocks(_queries(test), train).select("q", "place", "label", r("share").alias("share"))


@query("""select a.vec_id, round(list_distance(a.embedding::double[], b.embedding::double[]), 6) distance from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def knn_euclidean(spark: SparkSession, d: str) -> DataFrame:
    e = fixtures.read(spark, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", r(knn.euclidean(F.col("embedding"), F.col("other"))).alias("distance"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    test, train = _split(spark, d)
    return training.predictions(test, train)


MATRIX = VOTES + """, labels_ as (select distinct cast(label as varchar) label from m),
matrix as (select a.label actual, b.label predicted, count(p.q) n from labels_ a cross join labels_ b left join pairs p on p.expected = a.label and p.predicted = b.label group by all)"""


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion_matrix(_pairs(spark, d), _split(spark, d)[1].select("label").distinct())


@query(f"with {MATRIX} select * from matrix")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _matrix(spark, d)


@query(f"with {VOTES} select count(*) total, count(*) filter (expected = predicted) correct, round(avg(case when expected = predicted then 1.0 else 0 end), 6) accuracy from pairs")
def char_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return metrics.accuracy(_pairs(spark, d), 0.0).select("total", "correct", r("accuracy").alias("accuracy"))


@query(f"with {VOTES} select expected label, count(*) n, round(avg(case when expected = predicted then 1.0 else 0 end), 6) accuracy from pairs group by all")
def per_class_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return metrics.per_class_accuracy(_pairs(spark, d)).select("label", "n", r("accuracy").alias("accuracy"))


@query(f"""with {MATRIX}, rs as (select actual label, sum(n) t, sum(n) filter (actual = predicted) h from matrix group by all), cs as (select predicted label, sum(n) t from matrix group by all)
select label, round(case when cs.t = 0 then 0 else h / cs.t end, 6) "precision", round(case when rs.t = 0 then 0 else h / rs.t end, 6) recall from rs join cs using (label)""")
def precision_recall(spark: SparkSession, d: str) -> DataFrame:
    return metrics.precision_recall(_matrix(spark, d)).select("label", r("precision").alias("precision"), r("recall").alias("recall"))


@query(f"""with {VOTES}, w as (select expected actual, predicted, count(*) n, min(q) f from pairs where expected <> predicted group by all)
select actual, predicted, n, row_number() over (order by n desc, f) place from w qualify place <= 10""")
def top_misclassifications(spark: SparkSession, d: str) -> DataFrame:
    return metrics.top_misclassifications(_pairs(spark, d), "sample_idx")


@query(f"""with {VOTES} select (select count(*) from m) samples, count(*) total, count(*) filter (expected = predicted) correct, round(avg(case when expected = predicted then 1.0 else 0 end), 6) accuracy from pairs""")
def train_on_partitions(spark: SparkSession, d: str) -> DataFrame:
    """The model of the train partition, stored in parts, read again and judged on the test partition."""
    test, train = _split(spark, d)
    tables.save_model_parts(train, root := scratch.new_path(spark, "models"), "invoice_es", "v1")
    model = tables.read_model_parts(spark, root, "invoice_es", "v1")
    judged = metrics.accuracy(training.predictions(test, model), 0.0)
    return judged.withColumn("samples", model.agg(F.count("*")).scalar()).select("samples", "total", "correct", r("accuracy").alias("accuracy"))


_STRATIFIED = """s as (select *, row_number() over (partition by label order by vec_id) <= floor(count(*) over (partition by label) * 0.8 + 0.5) train from embeddings),
q as (select vec_id, label, embedding::double[] e from s where not train), m as (select vec_id, label, embedding::double[] e from s where train),
dist as"""


@query(f"with {MATRIX.replace(MATRIX[: MATRIX.index('dist as')] + 'dist as', _STRATIFIED)}, rs as (select actual label, sum(n) t, sum(n) filter (actual = predicted) h from matrix group by all), cs as (select predicted label, sum(n) t from matrix group by all) select label, round(case when cs.t = 0 then 0 else h / cs.t end, 6) \"precision\", round(case when rs.t = 0 then 0 else h / rs.t end, 6) recall from rs join cs using (label)")
def train_and_evaluate(spark: SparkSession, d: str) -> DataFrame:
    """Training with a stratified split: precision and recall of each label on what was held out."""
    done = training.train(fixtures.descriptors(spark, d))
    return done["by_label"].select("label", r("precision").alias("precision"), r("recall").alias("recall"))


@query(f"with {VOTES} select q sample_idx, expected, predicted, round(share, 6) confidence from pairs")
def evaluate_active(spark: SparkSession, d: str) -> DataFrame:
    """The test partition by the model that is active, of two that are stored."""
    s, root = fixtures.descriptors(spark, d), scratch.new_path(spark, "models")
    train = s.where("dataset_partition = 'train'")
    tables.save_model_parts(train.where("sample_idx % 2 = 0"), root, "invoice_es", "half")
    tables.save_model_parts(train, root, "invoice_es", "whole")
    tables.activate(spark, root, "invoice_es", "half")
    tables.activate(spark, root, "invoice_es", "whole")
    active = repository.active_model(tables.scan(spark, root, "model_events")).first()
    found = training.evaluate_active(tables.read_model_parts(spark, root, active.document_type, active.version), s)
    return found.select("sample_idx", "expected", "predicted", r("confidence").alias("confidence"))


@query("""select vec_id sample_idx, cast(label as varchar) label, row_number() over (partition by label order by vec_id) <= floor(count(*) over (partition by label) * 0.8 + 0.5) train from embeddings""")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return training.stratified_split(fixtures.descriptors(spark, d)).select("sample_idx", "label", "train")


@query("select cast(label as varchar) label, count(*) n from embeddings group by all")
def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return training.label_counts(fixtures.descriptors(spark, d))


@query("""select 'total' kind, '' as key, count(*) n from embeddings union all select 'label', cast(label as varchar), count(*) from embeddings group by label
union all select 'partition', case when vec_id % 5 <> 0 then 'train' else 'test' end, count(*) from embeddings group by 2""")
def dataset_stats(spark: SparkSession, d: str) -> DataFrame:
    return repository.dataset_stats(fixtures.descriptors(spark, d))


# --- images ---


def _triples(spark: SparkSession, d: str) -> DataFrame:
    """Colour images of three vectors each."""
    px = fixtures.images8(spark, d).withColumns({"c": F.col("img") % 3, "img": F.floor(F.col("img") / 3)})
    return px.groupBy("img", "x", "y").agg(*[F.max(F.when(F.col("c") == k, F.col("v"))).alias(n) for k, n in enumerate("rgb")]).na.drop()


@query(f"""with {PIXELS}, c as (select img // 3 img, x, y, max(v) filter (img % 3 = 0) r, max(v) filter (img % 3 = 1) g, max(v) filter (img % 3 = 2) b from px group by img // 3, x, y)
select img, x, y, cast(floor(0.299::double * r + 0.587::double * g + 0.114::double * b + 0.5) as int) v from c where r is not null and g is not null and b is not null""")
def gray_bt601(spark: SparkSession, d: str) -> DataFrame:
    return pixels.grayscale(_triples(spark, d))


@query(f"""with {PIXELS}, b as (select *, min(v) over (partition by img) lo, max(v) over (partition by img) hi from px)
select img, x, y, cast(case when lo = hi then v else floor((v - lo) / (hi - lo) * 255 + 0.5) end as int) v from b""")
def stretch(spark: SparkSession, d: str) -> DataFrame:
    return pixels.stretch(fixtures.images8(spark, d))


@query(f"with {PIXELS} select img, round(avg(v), 6) mean, round(stddev_pop(v), 6) stddev, round(median(v), 6) median from px group by img")
def histogram_stats(spark: SparkSession, d: str) -> DataFrame:
    return pixels.histogram_stats(fixtures.images8(spark, d)).select("img", *[r(c).alias(c) for c in ("mean", "stddev", "median")])


@query(f"with {PIXELS}, s as (select distinct img, t from px, range(256) x(t)) select s.img, cast(t as int) v, count(px.img) n from s left join px on px.img = s.img and px.v = t group by all")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return pixels.histogram(fixtures.images8(spark, d))


OTSU = PIXELS + """, h as (select img, t, (select count(*) from px where px.img = i.img and px.v = t) n from (select distinct img from px) i, range(256) x(t)),
cum as (select img, t, coalesce(sum(n) over w, 0)::double w0, coalesce(sum(n * t) over w, 0)::double s0, (sum(n) over (partition by img))::double w, (sum(n * t) over (partition by img))::double s
  from h window w as (partition by img order by t rows between unbounded preceding and 1 preceding)),
bet as (select img, t, case when w0 > 0 and w - w0 > 0 then w0 / w * ((w - w0) / w) * (s0 / w0 - (s - s0) / (w - w0)) * (s0 / w0 - (s - s0) / (w - w0)) else 0 end b from cum),
best as (select img, max(b) m from bet group by img),
otsu as (select b.img, cast(coalesce(floor((min(t) filter (b = m and m > 0) + max(t) filter (b = m and m > 0)) / 2 + 0.5), 128) as int) threshold from bet b join best using (img) group by b.img)"""


@query(f"with {OTSU} select * from otsu")
def otsu_threshold(spark: SparkSession, d: str) -> DataFrame:
    return pixels.otsu(fixtures.images8(spark, d))


@query(f"with {OTSU} select img, x, y, case when v >= threshold * 1.1::double then 255 else 0 end v from px join otsu using (img)")
def binarize(spark: SparkSession, d: str) -> DataFrame:
    return pixels.binarize(fixtures.images8(spark, d), 1.1)


@query(f"with {BINARY} select img, x, y, case when 2 * count(*) filter (v = 255) over (partition by img) > 64 then 255 - v else v end v from bw")
def polarity(spark: SparkSession, d: str) -> DataFrame:
    return pixels.text_as_foreground(fixtures.binary8(spark, d))


@query(f"""with {BINARY} select img, 'y' axis, y as at, count(*) filter (v = 255) n from bw group by all
union all select img, 'x', x, count(*) filter (v = 255) from bw group by img, x""")
def projections(spark: SparkSession, d: str) -> DataFrame:
    return pixels.projections(fixtures.binary8(spark, d))


@query(f"with {LINES} select img, line, low, high from lines_")
def line_islands(spark: SparkSession, d: str) -> DataFrame:
    return pixels.lines(fixtures.binary8(spark, d), 3)


@query(f"with recursive {COMPONENTS} select img, x, y, component from parts")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return pixels.components(fixtures.binary8(spark, d))


@query(ORACLE_SQL["connected_components"])
def components_tiled(spark: SparkSession, d: str) -> DataFrame:
    """The same components from tiles of 3 x 3 pixels and the graph of their seams."""
    return pixels.components_tiled(fixtures.binary8(spark, d), 3)


@query(f"with recursive {BOXED} select img, line, component from overlap")
def component_line_overlap(spark: SparkSession, d: str) -> DataFrame:
    px = fixtures.binary8(spark, d)
    return pixels.line_components(pixels.lines(px, 3), pixels.boxes(pixels.components(px))).select("img", "line", "component")


WORDS = BOXED + """, cols as (select o.img, o.line, p.x, count(*) n from overlap o join parts p on p.img = o.img and p.component = o.component group by all having count(*) >= 2),
ci as (select *, x - row_number() over (partition by img, line order by x) g from cols),
cr as (select img, line, g, min(x) low, max(x) high from ci group by all),
words_ as (select img, line, row_number() over (partition by img, line order by low) - 1 word, low, high from cr)"""


def _words(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    px = fixtures.binary8(spark, d)
    lines, parts = pixels.lines(px, 3), pixels.components(px)
    return pixels.words(lines, parts, 2), pixels.line_components(lines, pixels.boxes(parts))


@query(f"with recursive {WORDS} select img, line, word, low, high from words_")
def word_islands(spark: SparkSession, d: str) -> DataFrame:
    return _words(spark, d)[0]


@query(f"""with recursive {WORDS} select w.img, w.line, word, component, row_number() over (partition by w.img, w.line, word order by x0, component) - 1 "char"
from words_ w join overlap o on o.img = w.img and o.line = w.line and x0 <= w.high and x1 >= w.low""")
def word_components(spark: SparkSession, d: str) -> DataFrame:
    return pixels.word_components(*_words(spark, d)).select("img", "line", "word", "component", "char")


@query(f"with recursive {BOXED} select img, component, x0, x1, y0, y1 from boxes where y1 - y0 + 1 between 2 and 6")
def char_height_filter(spark: SparkSession, d: str) -> DataFrame:
    return pixels.fit_height(pixels.boxes(pixels.components(fixtures.binary8(spark, d))), 2, 6).select("img", "component", "x0", "x1", "y0", "y1")


@query(f"""with recursive {WORDS}, c as (select w.img, w.line, w.word, w.low, w.high, component, row_number() over (partition by w.img, w.line, word order by x0, component) - 1 ch, y1 - y0 + 1 h
  from words_ w left join overlap o on o.img = w.img and o.line = w.line and x0 <= w.high and x1 >= w.low),
size_ as (select img, count(*) filter (v = 255) white from bw group by img)
select s.img, white, l.line, l.low line_low, l.high line_high, w.word, w.low word_low, w.high word_high, c.ch as "char", c.component, case when c.component is not null then 108 end n_values, c.component is not null as read
from size_ s left join lines_ l on l.img = s.img left join words_ w on w.img = l.img and w.line = l.line left join c on c.img = w.img and c.line = w.line and c.word = w.word and c.h between 2 and 6""")
def debug_levels(spark: SparkSession, d: str) -> DataFrame:
    """The levels of the debug report of every picture, a row a character; nulls where a level is empty."""
    model = fixtures.descriptors(spark, d).where("sample_idx % 10 = 0").select("sample_idx", "label", F.flatten(F.array("descriptor", F.slice("descriptor", 1, 44))).alias("descriptor"))
    report = debugging.debug_report(fixtures.binary8(spark, d), model, 3, 2, 2, 6)
    line = report.select("img", "white", F.explode_outer("lines").alias("l"))
    word = line.select("img", "white", "l.line", F.col("l.low").alias("line_low"), F.col("l.high").alias("line_high"), F.explode_outer("l.words").alias("w"))
    char = word.select("img", "white", "line", "line_low", "line_high", "w.word", F.col("w.low").alias("word_low"), F.col("w.high").alias("word_high"), F.explode_outer("w.characters").alias("c"))
    n_values = F.when(F.col("c").isNotNull(), F.size("c.descriptor"))
    return char.select(*char.columns[:-1], "c.char", "c.component", n_values.alias("n_values"), F.coalesce(F.col("c.confidence") > 0, F.lit(False)).alias("read"))


@query(f"""with {BINARY}, p as (select img, count(*) filter (v = 255) raw from bw group by img),
f as (select bw.img, x, y, case when 2 * raw > 64 then 255 - v else v end v from bw join p using (img)),
rw as (select img, y, count(*) filter (v = 255) n from f group by all),
st as (select img, y, n, case when n >= 3 and coalesce(lag(n) over (partition by img order by y), 0) < 3 then 1 else 0 end s from rw)
select p.img, 64 pixels, raw raw_white, sum(n) white, count(*) filter (n < 3) valley_rows, count(*) filter (n >= 3) text_rows, sum(s) line_runs, sum(n) <> raw inverted,
       greatest(sum(n), 64 - sum(n)) / 64 > 0.98 extreme_skew from p join st using (img) group by p.img, raw""")
def lab_debug_stats(spark: SparkSession, d: str) -> DataFrame:
    return pixels.lab_stats(fixtures.binary8(spark, d), 3)


_NEAR = """nb as (select a.img, a.x, a.y, dx, dy, b.v w from px a, (values (-1), (0), (1)) u(dx), (values (-1), (0), (1)) t(dy), px b
  where b.img = a.img and b.x = least(greatest(a.x + dx, 0), 7) and b.y = least(greatest(a.y + dy, 0), 7))"""


@query(f"""with {PIXELS}, {_NEAR} select img, x, y, cast(least(greatest(floor(sum(w * (exp(-(dx * dx + dy * dy) / 2.0::double) / (1 + 4 * exp(-0.5::double) + 4 * exp(-1.0::double)))) + 0.5), 0), 255) as int) v
from nb group by img, x, y""")
def gaussian_blur(spark: SparkSession, d: str) -> DataFrame:
    return pixels.blur(fixtures.images8(spark, d))


@query(f"with {PIXELS}, {_NEAR} select img, x, y, list_sort(list(w))[5] v from nb group by img, x, y")
def median_filter(spark: SparkSession, d: str) -> DataFrame:
    return pixels.median(fixtures.images8(spark, d))


@query(ORACLE_SQL["gaussian_blur"])
def blur_tiled(spark: SparkSession, d: str) -> DataFrame:
    """The same blur from tiles of 3 x 3 pixels with a rim of one."""
    return pixels.blur(fixtures.images8(spark, d), tile=3)


@query(ORACLE_SQL["median_filter"])
def median_tiled(spark: SparkSession, d: str) -> DataFrame:
    return pixels.median(fixtures.images8(spark, d), tile=3)


def _moved(sx: str, sy: str) -> str:
    return f"""with {PIXELS} select a.img, a.x, a.y, coalesce(b.v, 255) v from (select img, x, y, cast(floor({sx} + 0.5) as bigint) sx, cast(floor({sy} + 0.5) as bigint) sy from px) a
left join px b on b.img = a.img and b.x = a.sx and b.y = a.sy"""


@query(_moved("4 + (x - 4) * cos(radians(-10)) - (y - 4) * sin(radians(-10))", "4 + (x - 4) * sin(radians(-10)) + (y - 4) * cos(radians(-10))"))
def rotate(spark: SparkSession, d: str) -> DataFrame:
    return pixels.rotate(fixtures.images8(spark, d), 10)


@query(_moved("4 + (x - 4) / 1.3::double", "4 + (y - 4) / 1.3::double"))
def scale(spark: SparkSession, d: str) -> DataFrame:
    return pixels.scale(fixtures.images8(spark, d), 1.3)


@query(_moved("x - 1.7::double * ((y - 4) / 4)", "y - 0.6::double * ((x - 4) / 4)"))
def skew(spark: SparkSession, d: str) -> DataFrame:
    return pixels.skew(fixtures.images8(spark, d), 1.7, 0.6)


def _crop(spark: SparkSession, d: str) -> DataFrame:
    return pixels.crop_foreground(fixtures.binary8(spark, d).where("x <> 0 and y > 1").select("img", (F.col("x") - 1).alias("x"), (F.col("y") - 2).alias("y"), "v"))


CROP = BINARY + """, part as (select img, x - 1 x, y - 2 y, v from bw where x <> 0 and y > 1),
box as (select img, min(x) x0, max(x) x1, min(y) y0, max(y) y1 from part where v = 255 group by img),
crop as (select p.img, x - x0 x, y - y0 y, v from part p join box using (img) where x between x0 and x1 and y between y0 and y1
  union all select img, 0, 0, 0 from (select distinct img from part) where img not in (select img from box))"""


@query(f"with {CROP} select * from crop")
def crop_foreground(spark: SparkSession, d: str) -> DataFrame:
    return _crop(spark, d)


@query(f"""with {CROP}, dm as (select img, max(x) + 1 w, max(y) + 1 h from crop group by img),
nd as (select *, greatest(1, case when w >= h then 16 else cast(floor(16 * (w / h) + 0.5) as bigint) end) nw, greatest(1, case when w >= h then cast(floor(16 / (w / h) + 0.5) as bigint) else 16 end) nh from dm),
grid as (select *, x - (16 - nw) // 2 a, y - (16 - nh) // 2 b from nd, range(16) u(x), range(16) t(y))
select g.img, cast(g.x as int) x, cast(g.y as int) y, coalesce(c.v, 0) v from grid g left join crop c on c.img = g.img and a between 0 and nw - 1 and b between 0 and nh - 1 and c.x = least(w - 1, a * w // nw) and c.y = least(h - 1, b * h // nh)""")
def resize_center(spark: SparkSession, d: str) -> DataFrame:
    return pixels.fit_square(_crop(spark, d), 16)


GRADIENT = PIXELS + """, gr as (select a.img, a.x, a.y, (e.v - w.v)::double gx, (s.v - n.v)::double gy from px a
  join px e on e.img = a.img and e.y = a.y and e.x = least(a.x + 1, 7) join px w on w.img = a.img and w.y = a.y and w.x = greatest(a.x - 1, 0)
  join px s on s.img = a.img and s.x = a.x and s.y = least(a.y + 1, 7) join px n on n.img = a.img and n.x = a.x and n.y = greatest(a.y - 1, 0)),
grad as (select img, x, y, sqrt(gx * gx + gy * gy) magnitude, degrees(atan2(gy, gx)) + case when degrees(atan2(gy, gx)) < 0 then 180 else 0 end angle from gr)"""


@query(f"with {GRADIENT} select img, x, y, round(magnitude, 6) magnitude, round(angle, 6) angle from grad")
def gradient(spark: SparkSession, d: str) -> DataFrame:
    return pixels.gradient(fixtures.images8(spark, d)).select("img", "x", "y", r("magnitude").alias("magnitude"), r("angle").alias("angle"))


@query(f"""with {GRADIENT}, c as (select img, cast(y // 4 * 2 + x // 4 as int) region, cast(floor(angle / 20 + 0.5) as int) % 9 bin, sum(magnitude) m from grad group by all having sum(magnitude) > 0)
select img, region, bin, round(m / sqrt(sum(m * m) over (partition by img, region) + 0.000001), 4) as value from c""")
def hog(spark: SparkSession, d: str) -> DataFrame:
    return pixels.hog(fixtures.images8(spark, d), cols=2, rows=2).select("img", "region", "bin", r("value", 4).alias("value"))


@query(f"""with {PIXELS} select img, x, y, case when substr(md5('0|' || img || '|' || x || '|' || y), 1, 8) < '{round(config.NOISE_LEVEL * (1 << 32)):08x}' then 255 - v else v end v from px""")
def salt_pepper(spark: SparkSession, d: str) -> DataFrame:
    return pixels.salt_pepper(fixtures.images8(spark, d), config.NOISE_LEVEL)


@query(f"""with {GRADIENT}, c as (select img, cast(case when y < 2 then 0 when y < 5 then 1 else 2 end * 4 + x // 2 as int) region, cast(floor(angle / 20 + 0.5) as int) % 9 bin, sum(magnitude) m from grad group by all having sum(magnitude) > 0)
select img, region, bin, round(m / sqrt(sum(m * m) over (partition by img, region) + 0.000001), 4) as value from c""")
def hog_grid(spark: SparkSession, d: str) -> DataFrame:
    """The default grid of 4 x 3 regions."""
    return pixels.hog(fixtures.images8(spark, d)).select("img", "region", "bin", r("value", 4).alias("value"))


@query(f"""with {PIXELS} select img, case when img % 50 <> 0 then 8 end width, case when img % 50 <> 0 then 8 end height, case when img % 50 <> 0 then cast(sum(v) as bigint) end total, img % 50 = 0 failed from px group by img""")
def png_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every picture as a PNG file written by tasks and read again; each fiftieth file is cut short."""
    made = tables.png_files(fixtures.pictures8(spark, d))
    whole = F.regexp_extract("name", r"\d+", 0).cast("long") % 50 != 0
    files.write_files(made.withColumn("content", F.when(whole, F.col("content")).otherwise(F.substring("content", 1, 30))), path := scratch.new_path(spark, "png"))
    back = images.read_images(spark, path)
    byte = lambda i: F.conv(F.hex(F.substring("gray", i, F.lit(1))), 16, 10).cast("long")
    total = F.aggregate(F.sequence(F.lit(1), F.octet_length("gray")), F.lit(0).cast("long"), lambda s, i: s + byte(i))
    return back.select(F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long").alias("img"), "width", "height", total.alias("total"), F.col("error").isNotNull().alias("failed"))


@query("select vec_id from embeddings where vec_id % 5 = 0 or vec_id % 7 = 0")
def orphan_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of every picture: each fifth was never inserted, each seventh document was deleted."""
    root = scratch.new_path(spark, "uploads")
    made = tables.png_files(fixtures.pictures8(spark, d)).withColumn("id", F.regexp_extract("name", r"\d+", 0).cast("long"))
    tables.create_document(made.where("id % 5 <> 0"), root)
    files.write_files(made.where("id % 5 = 0"), f"{root}/files/failed")
    tables.delete_document(made.where("id % 7 = 0").select("id"), root)
    found = tables.orphans(spark, root, tables.scan(spark, root, "documents"), tables.scan(spark, root, "tombstones"))
    return found.select(F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long").alias("vec_id"))


@query()
def hog_svg(spark: SparkSession, d: str) -> DataFrame:
    e = fixtures.read(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 36).alias("h"))

    def draw(batches):
        for b in batches:
            b["svg"] = [reports.hog_svg(h, cols=2, rows=2) for h in b.h]
            yield b[["vec_id", "svg"]]

    return e.mapInPandas(draw, "vec_id long, svg string")


# --- images to text ---

SUPPLIER_INVOICES = INVOICES.replace(INVOICES[: INVOICES.index("lists as (")], f"""amounts as (select s_suppkey k0, s_name, abs({_CENTS.format('s_acctbal')}) v from supplier),
sums as (select *, v * 19 // 100 i from amounts),
written as (
  select k0 doc_id, k0 % 7 k, s_name c_name, cast(k0 + 900000000 as varchar) n, strftime(date '2024-01-01' + cast(k0 % 300 as int), '%Y-%m-%d') d,
         {_MONEY.format('i')} iva, {_MONEY.format('v')} valor, {_MONEY.format('(v + i)')} total, i, v from sums),
""")
SUPPLIER_FIELDS = ",\n".join((SUPPLIER_INVOICES, _PROVEEDOR, _NIT, _FECHA, _IVA, _VALOR, _TOTAL))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of the suppliers' invoices: drawn, written as PNG files by tasks, read again.  Each fortieth file is cut short."""
    made = script.png_pages(fixtures.supplier_invoices(spark, d))
    whole = F.regexp_extract("name", r"\d+", 0).cast("long") % 40 != 0
    files.write_files(made.withColumn("content", F.when(whole, F.col("content")).otherwise(F.substring("content", 1, 40))), path := scratch.new_path(spark, "pages"))
    return images.read_images(spark, path).withColumn("path", F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long"))


@query(f"""with {SUPPLIER_INVOICES} select doc_id path, case when doc_id % 40 <> 0 then t end raw_text, case when doc_id % 40 <> 0 then len(l) else -1 end n_lines, doc_id % 40 = 0 failed from inv""")
def ocr_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Images to text: what is read from the drawn pages is what was written on them."""
    out = ocr.ocr_documents(_pages(spark, d), script.model(spark))
    return out.select("path", "raw_text", F.coalesce(F.size("lines"), F.lit(-1)).alias("n_lines"), F.col("error").isNotNull().alias("failed"))


@query(f"""with {SUPPLIER_INVOICES}, page as (select doc_id path, cast({2 * script.MARGIN} + list_max(list_transform(l, lambda x: {script.WIDTH} * length(x) - {script.WIDTH - script.SPACE} * (length(x) - length(replace(x, ' ', ''))))) as int) width,
  cast({2 * script.MARGIN} + {script.PITCH} * len(l) as int) height from inv where doc_id % 40 <> 0)
select path, unnest(['gray', 'stretch', 'blur', 'binary', 'foreground']) as name, width, height from page""")
def debug_report(spark: SparkSession, d: str) -> DataFrame:
    """Size of each page after each step of preprocessing."""
    out = ocr.ocr_documents(_pages(spark, d).where("error is null"), script.model(spark), debug=True)
    return out.select("path", F.inline("stages")).select("path", "name", "width", "height")


@query(f"""with {SUPPLIER_FIELDS}, {LONG_FIELDS} select doc_id, true same_text, true same_fields, 1::double score, 0::double confidence_variance, round(var_pop(value_num), 4) value_variance
from long where doc_id % 40 <> 0 and (position < 3 or value_num is not null) group by doc_id""")
def reproducibility(spark: SparkSession, d: str) -> DataFrame:
    runs = ocr.repeat_runs(_pages(spark, d).where("error is null"), script.model(spark), 2)
    found = fields.extract_fields(runs).select("doc_id", "run", "raw_text", "confidence", *[F.col(f)["value"].alias(f) for f in config.VALIDATION_FIELDS])
    return metrics.reproducibility(found).withColumn("value_variance", r("value_variance", 4))


@query(ORACLE_SQL["fields_metrics"].replace(ALL_FIELDS, SUPPLIER_FIELDS).replace("from judged group by", "from judged where doc_id % 40 <> 0 group by"))
def field_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the six fields, from the images of invoices to their values."""
    m = ocr.evaluate_fields(_pages(spark, d), script.model(spark), fixtures.supplier_truth(spark, d))
    return m.select("position", "field", "n", "tp", "fp", "fn", *[r(c).alias(c) for c in ("confidence", "accuracy", "precision", "recall", "f1")])


@query()
def synthesize(spark: SparkSession, d: str) -> DataFrame:
    made = training.synthesize(spark, ["1", "7", "A"], per_character=8, fonts=("Arial", "Courier New"))
    return made.select("sample_idx", "label", "source_document", "width", "height", F.crc32("gray").alias("gray_crc32"))


_TIMES = """t as (select l_orderkey doc_id, sum(l_quantity) a, sum(l_discount * 100) b, sum(l_extendedprice / 100) c, sum(l_tax * 10) e from lineitem group by 1)"""


@query(f"""with {_TIMES}, x as (select count(*) documents, sum(a + b + c + e) s, avg(a + b + c + e) m, avg(a) pa, avg(b) pb, avg(c) pc, avg(e) pe,
  percentile_disc(0.95) within group (order by a + b + c + e) p95, percentile_disc(0.99) within group (order by a + b + c + e) p99 from t)
select documents, round(s, 3) total_ms, round(m, 6) mean_ms, round(pa, 6) preprocess, round(pb, 6) segmentation, round(pc, 6) recognition, round(pe, 6) extraction, round(p95, 6) p95, round(p99, 6) p99,
  case greatest(pa, pb, pc, pe) when pa then 'preprocess' when pb then 'segmentation' when pc then 'recognition' else 'extraction' end bottleneck, round(1000 / m, 6) throughput from x""")
def benchmark_stats(spark: SparkSession, d: str) -> DataFrame:
    li = fixtures.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"))
    t = li.agg(
        F.sum("l_quantity").alias("preprocess"), F.sum(F.col("l_discount") * 100).alias("segmentation"),
        F.sum(F.col("l_extendedprice") / 100).alias("recognition"), F.sum(F.col("l_tax") * 10).alias("extraction"),
    )
    m = metrics.benchmark(t.withColumn("total", F.col("preprocess") + F.col("segmentation") + F.col("recognition") + F.col("extraction")))
    rounded = [r(c, 3 if c == "total_ms" else 6).alias(c) for c in ("total_ms", "mean_ms", *metrics.STAGES, "p95", "p99")]
    return m.select("documents", *rounded, "bottleneck", r("throughput").alias("throughput"))


@query(ORACLE_SQL["benchmark_stats"].replace("sum(l_", "avg(l_"))
def benchmark_runs(spark: SparkSession, d: str) -> DataFrame:
    """Each line of an order is a run of its document."""
    li = fixtures.read(spark, d, "lineitem")
    runs = li.select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_quantity").alias("preprocess"), (F.col("l_discount") * 100).alias("segmentation"),
        (F.col("l_extendedprice") / 100).alias("recognition"), (F.col("l_tax") * 10).alias("extraction"),
    )
    whole = runs.withColumn("total", F.col("preprocess") + F.col("segmentation") + F.col("recognition") + F.col("extraction"))
    m = metrics.benchmark(metrics.run_means(whole))
    rounded = [r(c, 3 if c == "total_ms" else 6).alias(c) for c in ("total_ms", "mean_ms", *metrics.STAGES, "p95", "p99")]
    return m.select("documents", *rounded, "bottleneck", r("throughput").alias("throughput"))


# --- documents ---


@query(f"with {DOCS} select id, owner_id, status, {_T.format('created_at')} created_at from docs where status = 'processed' and created_at >= timestamp '1995-01-01' and created_at <= timestamp '1996-12-31' order by docs.created_at desc, id limit 20 offset 20")
def list_documents(spark: SparkSession, d: str) -> DataFrame:
    f = repository.Filters(status="processed", date_from="1995-01-01", date_to="1996-12-31")
    return repository.list_documents(fixtures.documents(spark, d), fixtures.ocr_results(spark, d), f, 2).select("id", "owner_id", "status", ts("created_at").alias("created_at"))


@query(f"with {DOCS}, {RESULTS} select id, status from docs where id in (select document_id from res where proveedor ilike '%00001%') and owner_id is not null")
def list_by_provider(spark: SparkSession, d: str) -> DataFrame:
    return repository.filtered(fixtures.documents(spark, d), fixtures.ocr_results(spark, d), repository.Filters(provider="00001")).select("id", "status")


@query(f"with {DOCS}, {RESULTS} select id, status from docs where id in (select document_id from res where proveedor ilike '%7%' and total >= 20000 and total <= 30000)")
def list_by_amount(spark: SparkSession, d: str) -> DataFrame:
    f = repository.Filters(provider="7", min_amount=20000, max_amount=30000)
    return repository.filtered(fixtures.documents(spark, d), fixtures.ocr_results(spark, d), f).select("id", "status")


@query(f"""with {DOCS}, hits as (select id, status, created_at from docs where status = 'validated' and created_at < timestamp '1999-01-01')
select id, (select count(*) from hits) exact_total from hits order by created_at desc, id limit 50 offset 100""")
def list_with_total(spark: SparkSession, d: str) -> DataFrame:
    f = repository.Filters(status="validated", date_to="1998-12-31", inclusive_day=True)
    return repository.list_with_total(fixtures.documents(spark, d), fixtures.ocr_results(spark, d), f, 3, 50).select("id", "exact_total")


_PAGES = (1, 3, 100, 10_000_000)


@query(f"""with {DOCS}, hits as (select id, status, row_number() over (order by created_at desc, id) - 1 as position from docs where status <> 'uploaded'),
p as (select unnest([{', '.join(map(str, _PAGES))}]) page)
select cast(page as int) page, (select count(*) from hits) exact_total, position, id, status from p left join hits on position >= (page - 1) * 40 and position < page * 40""")
def page_index(spark: SparkSession, d: str) -> DataFrame:
    """Near and far pages of a filtered listing from its index; the last is empty, but knows the total."""
    rows = fixtures.documents(spark, d).where("status <> 'uploaded'").select("id", "status", "created_at")
    index = paging.PageIndex.build(rows, scratch.new_path(spark, "pages"))
    pages = [index.page(n, 40).select("page", "exact_total", "position", "id", "status") for n in _PAGES]
    return pages[0].union(pages[1]).union(pages[2]).union(pages[3])


@query(f"with {DOCS}, {RESULTS} select id, status from docs where id in (select document_id from res where line_no not in (3, 4) and proveedor ilike '%7%' and total >= 20000 and total <= 30000)")
def list_by_json_path(spark: SparkSession, d: str) -> DataFrame:
    f = repository.Filters(provider="7", min_amount=20000, max_amount=30000)
    return repository.filtered(fixtures.documents(spark, d), fixtures.extracted_results(spark, d), f).select("id", "status")


@query(f"with {DOCS}, {PROFILES} select docs.id, email owner_email from docs left join prof on prof.id = owner_id")
def list_with_owner(spark: SparkSession, d: str) -> DataFrame:
    return repository.with_owner(fixtures.documents(spark, d), fixtures.profiles(spark, d)).select("id", "owner_email")


@query(f"with {DOCS}, {RESULTS} select id, count(document_id) n, coalesce(round(sum(cast(confidence as double)), 6), 0) total_confidence from docs left join res on document_id = id group by id")
def list_with_confidence(spark: SparkSession, d: str) -> DataFrame:
    rows = repository.with_results(fixtures.documents(spark, d), fixtures.ocr_results(spark, d))
    total = F.aggregate("ocr_results", F.lit(0.0), lambda s, x: s + x["confidence"].cast("double"))
    return rows.select("id", F.size("ocr_results").cast("long").alias("n"), r(total).alias("total_confidence"))


@query(f"""with {DOCS}, {LATEST}, {LAST_VALIDATION}
select id, status, cast(r.confidence as double) confidence, r.proveedor, cast(r.total as double) total, v.manually_edited, {_T.format('v.validated_at')} validated_at
from docs left join lastres r on r.document_id = id left join lastval v on v.document_id = id""")
def document_detail(spark: SparkSession, d: str) -> DataFrame:
    rows = repository.document_detail(fixtures.documents(spark, d), fixtures.ocr_results(spark, d), fixtures.validations(spark, d))
    return rows.select("id", "status", F.col("confidence").cast("double").alias("confidence"), "proveedor", F.col("total").cast("double").alias("total"), "manually_edited", ts("validated_at").alias("validated_at"))


@query(f"""with {LATEST} select document_id, u.position, u.field, u.value_str, u.value_num, u.confidence from lastres, lateral (values
  (0, 'proveedor', proveedor, null::double, 0.9::double), (1, 'nit', null, null, 0), (2, 'fecha', null, null, 0), (3, 'iva', null, null, 0), (4, 'valor', null, null, 0),
  (5, 'total', null, case when line_no <> 3 then cast(total as double) end, case when line_no <> 3 then 0.95 else 0 end)) u(position, field, value_str, value_num, confidence)
where line_no <> 4""")
def document_fields(spark: SparkSession, d: str) -> DataFrame:
    return repository.document_fields(fixtures.extracted_results(spark, d))


@query("""with a as (select p_partkey id, case when p_partkey % 11 <> 0 then p_size / 3.0 - 5 end asked_page, case when p_partkey % 13 <> 0 then p_partkey % 160 - 8.5 end asked_size from part)
select id, cast(greatest(1, coalesce(trunc(asked_page), 1)) as int) page, cast(least(100, greatest(1, coalesce(trunc(asked_size), 20))) as int) size from a""")
def page_clamp(spark: SparkSession, d: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    asked = fixtures.read(spark, d, "part").select(key.alias("id"), F.when(key % 11 != 0, size / 3.0 - 5).alias("page"), F.when(key % 13 != 0, key % 160 - 8.5).alias("size"))
    return asked.select("id", *repository.clamped(F.col("page"), F.col("size")))


@query(f"with {LATEST} select document_id, line_no, part, cast(confidence as double) confidence, {_T.format('created_at')} created_at from lastres")
def latest_result(spark: SparkSession, d: str) -> DataFrame:
    last = repository.latest(fixtures.ocr_results(spark, d), "document_id", "created_at", "line_no", "part")
    return last.select("document_id", "line_no", "part", F.col("confidence").cast("double").alias("confidence"), ts("created_at").alias("created_at"))


@query(f"with {LAST_VALIDATION} select document_id, line_no, part, validated_by, manually_edited from lastval")
def latest_validation(spark: SparkSession, d: str) -> DataFrame:
    return repository.latest(fixtures.validations(spark, d), "document_id", "validated_at", "line_no", "part").select("document_id", "line_no", "part", "validated_by", "manually_edited")


_REPORT = f"""with {DOCS}, {LATEST}, {LAST_VALIDATION}, {PROFILES}, rep as (
select d.id, document_type, case status when 'uploaded' then 'Cargado' when 'processed' then 'Procesado' else 'Validado' end status,
  coalesce(printf('%.1f%%', cast(r.confidence as double) * 100), '') accuracy, {_T.format('v.validated_at')} validated_at, coalesce(p.email, '') validator, {_T.format('d.created_at')} created_at
from docs d left join lastres r on r.document_id = d.id left join lastval v on v.document_id = d.id left join prof p on p.id = v.validated_by)"""


def _report(spark: SparkSession, d: str) -> DataFrame:
    rows = reports.documents_report(fixtures.documents(spark, d), fixtures.ocr_results(spark, d), fixtures.validations(spark, d), fixtures.profiles(spark, d))
    return rows.withColumns({"validated_at": ts("validated_at"), "created_at": ts("created_at")})


@query(f"{_REPORT} select * from rep")
def documents_report(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d)


@query(f"""with {VALIDATIONS}, {PROFILES}
select document_id, line_no, part, u.position, u.field, u.before, u.after, coalesce(email, '') editor, {_T.format('validated_at')} validated_at
from val left join prof on prof.id = validated_by, lateral (values (0, 'Proveedor', proveedor, proveedor), (1, 'NIT', nit, trim(nit_after, '"')), (2, 'Fecha', '', ''), (3, 'IVA', iva, iva),
  (4, 'Valor', '', ''), (5, 'Total', cast(total as varchar), cast(total_after as varchar))) u(position, field, before, after)""")
def validations_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.validations_report(fixtures.validations(spark, d), fixtures.profiles(spark, d)).withColumn("validated_at", ts("validated_at"))


@query(f"""{_REPORT} select id, id || ',' || document_type || ',' || status || ',' || accuracy || ',' || coalesce(validated_at, '') || ',' || validator || ',' || created_at || ',"a ""b"", c"' line from rep""")
def csv_lines(spark: SparkSession, d: str) -> DataFrame:
    cells = [F.col(c) for c in ("id", "document_type", "status", "accuracy", "validated_at", "validator", "created_at")]
    return _report(spark, d).select("id", scalars.csv_line(*cells, F.lit('a "b", c')).alias("line"))


@query(f"""{_REPORT} select 'ID,Tipo,Status,Accuracy,ValidadoEn,UsuarioValidó,FechaCreación' line
union all select id || ',' || document_type || ',' || status || ',' || accuracy || ',' || coalesce(validated_at, '') || ',' || validator || ',' || created_at from rep""")
def documents_csv(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the download, written by tasks and read again."""
    path = tables.documents_csv(_report(spark, d), scratch.new_path(spark, "reports"), "2024-01-31")
    return spark.read.option("lineSep", "\r\n").text(path).where("value <> ''").select(F.col("value").alias("line"))


@query(f"""with {VALIDATIONS}, {PROFILES}, u as (select val.*, coalesce(email, '') editor, unnest(['Proveedor', 'NIT', 'Fecha', 'IVA', 'Valor', 'Total']) field,
  unnest([proveedor, nit, '', iva, '', cast(total as varchar)]) before, unnest([proveedor, trim(nit_after, '"'), '', iva, '', cast(total_after as varchar)]) after_ from val left join prof on prof.id = validated_by)
select 'DocumentoID,Campo,ValorOCR,ValorValidado,EditadoPor,FechaValidación' line union all
select document_id || ',' || field || ',' || before || ',' || after_ || ',' || editor || ',' || {_T.format('validated_at')} from u""")
def validations_csv(spark: SparkSession, d: str) -> DataFrame:
    rows = reports.validations_report(fixtures.validations(spark, d), fixtures.profiles(spark, d)).withColumn("validated_at", ts("validated_at"))
    path = tables.validations_csv(rows, scratch.new_path(spark, "reports"), "2024-01-31")
    return spark.read.option("lineSep", "\r\n").text(path).where("value <> ''").select(F.col("value").alias("line"))


@query(f"""with {VALIDATIONS} select 'document_validations' as "table", '' entry, count(*) n from val union all select 'status_events', 'validated', count(*) from val
union all select 'audit_logs', case when manually_edited then 'OCR_CORRECTED' else 'OCR_VALIDATED' end, count(*) from val group by 2
union all select 'ocr_results', '', count(*) from lineitem union all select 'status_events', 'processed', count(*) from lineitem union all select 'audit_logs', 'OCR_COMPLETED', count(*) from lineitem""")
def saved_units(spark: SparkSession, d: str) -> DataFrame:
    """What one write of validations and one of results leave in each table."""
    root = scratch.new_path(spark, "journal")
    tables.save_validation(fixtures.validations(spark, d), root)
    tables.save_ocr_result(fixtures.ocr_results(spark, d), root)
    entry = {"document_validations": F.lit(""), "ocr_results": F.lit(""), "status_events": F.col("status"), "audit_logs": F.col("action")}
    counts = [tables.entries(spark, root, t).groupBy(F.lit(t).alias("table"), e.alias("entry")).agg(F.count("*").alias("n")) for t, e in entry.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


def _models(spark: SparkSession) -> DataFrame:
    rows = [("invoice_es", f"v{k}", k == 3, f"2024-01-0{k}") for k in range(1, 5)]
    return spark.createDataFrame(rows, "document_type string, version string, active boolean, created_at string").withColumn("model_data", F.lit("{}"))


@query(f"""with {DOCS}, {RESULTS}, {VALIDATIONS} select count(*) total_documents, count(*) filter (status = 'validated') validated_documents, count(distinct owner_id) active_users,
  (select round(avg(cast(confidence as double)), 6) from res) average_confidence, (select count(*) filter (total <> total_after) + count(*) filter (nit <> nit_after) from val) total_fields_edited,
  1 active_models, round(100.0 * count(*) filter (status = 'validated') / count(*), 6) validation_pct from docs""")
def dashboard(spark: SparkSession, d: str) -> DataFrame:
    one = repository.dashboard(fixtures.documents(spark, d), fixtures.ocr_results(spark, d).withColumn("confidence", F.col("confidence").cast("double")), fixtures.validations(spark, d), _models(spark))
    return one.withColumns({"average_confidence": r("average_confidence"), "validation_pct": r("validation_pct")})


@query(f"""with {VALIDATIONS} select 0::bigint proveedor, count(*) filter (nit <> nit_after) nit, 0::bigint fecha, 0::bigint iva, 0::bigint valor, count(*) filter (total <> total_after) total,
  count(*) filter (nit <> nit_after) + count(*) filter (total <> total_after) total_edited from val""")
def field_edit_stats(spark: SparkSession, d: str) -> DataFrame:
    return repository.field_edits(fixtures.validations(spark, d))


@query(f"""with {VALIDATIONS}, e as (select unnest(['proveedor', 'nit', 'fecha', 'iva', 'valor', 'total']) field, unnest(range(6)) i,
  unnest([0, count(*) filter (nit <> nit_after), 0, 0, 0, count(*) filter (total <> total_after)]) edits from val)
select row_number() over (order by edits desc, i) - 1 place, field, edits from e""")
def fields_by_edits(spark: SparkSession, d: str) -> DataFrame:
    return repository.fields_by_edits(fixtures.validations(spark, d))


@query(f"with {VALIDATIONS} select count(*) total, count(*) filter (manually_edited) edited, round(coalesce(100.0 * count(*) filter (manually_edited) / nullif(count(*), 0), 0), 6) edited_pct from val")
def validation_totals(spark: SparkSession, d: str) -> DataFrame:
    return repository.validation_totals(fixtures.validations(spark, d)).withColumn("edited_pct", r("edited_pct"))


@query("""select greatest(1, coalesce(max(n), 1)) maximum from (select count(*) n from events where cast(ts as date) between date '2024-01-24' and date '2024-01-30' group by cast(ts as date))""")
def chart_maximum(spark: SparkSession, d: str) -> DataFrame:
    return repository.chart_maximum(repository.daily_buckets(fixtures.read(spark, d, "events"), "ts", 7, "2024-01-30"))


@query("""select cast(day as varchar) as day, count(event_id) total from (select unnest(generate_series(date '2024-01-24', date '2024-01-30', interval 1 day))::date as day) s
left join events on cast(ts as date) = s.day group by all""")
def daily_buckets(spark: SparkSession, d: str) -> DataFrame:
    return repository.daily_buckets(fixtures.read(spark, d, "events"), "ts", 7, "2024-01-30").withColumn("day", F.col("day").cast("string"))


@query("""select cast(day as varchar) as day, count(event_id) total, coalesce(round(100 * avg(case when event_type = 'click' then 1.0 when event_id is not null then 0 end), 6), 0) edited_pct
from (select unnest(generate_series(date '2024-01-28', date '2024-02-03', interval 1 day))::date as day) s left join events on cast(ts as date) = s.day group by all""")
def edit_trend(spark: SparkSession, d: str) -> DataFrame:
    e = fixtures.read(spark, d, "events").withColumn("edited", F.col("event_type") == "click")
    out = repository.daily_buckets(e, "ts", 7, "2024-02-03", edited="edited")
    return out.select(F.col("day").cast("string").alias("day"), "total", r("edited_pct").alias("edited_pct"))


@query(f"with {VALIDATIONS}, {PROFILES} select validated_by, email, count(*) total, count(*) filter (manually_edited) edited from val left join prof on id = validated_by group by all")
def validator_stats(spark: SparkSession, d: str) -> DataFrame:
    return repository.validator_stats(fixtures.validations(spark, d), fixtures.profiles(spark, d))


@query("""with a as (select cast(i as int) position, case when i < 10 then chr(cast(48 + i as int)) when i < 36 then chr(cast(55 + i as int)) else chr(cast(61 + i as int)) end label from range(62) t(i)),
s as (select cast(label as varchar) label, count(*) n from embeddings where vec_id % 5 <> 0 group by all), p as (select cast(label as varchar) label, count(*) n from embeddings where vec_id % 5 = 0 and vec_id % 10 <> 0 group by all)
select position, label, coalesce(s.n, 0) saved, coalesce(p.n, 0) pending, coalesce(s.n, 0) + coalesce(p.n, 0) total, coalesce(s.n, 0) + coalesce(p.n, 0) >= 100 met from a left join s using (label) left join p using (label)""")
def class_progress(spark: SparkSession, d: str) -> DataFrame:
    test, train = _split(spark, d)
    items = test.select(F.col("sample_idx").alias("idx"), "label", (F.col("sample_idx") % 10 == 0).alias("discarded"))
    return repository.class_progress(training.label_counts(train), repository.pending_counts(items))


@query("""with n as (select count(*) n from embeddings), i as (select row_number() over (order by vec_id) - 1 idx, label, vec_id from embeddings)
select min_by(idx, (idx - 7 - 1 + n) % n) next_idx from i, n where label = 3 and vec_id % 2 = 0""")
def next_pending(spark: SparkSession, d: str) -> DataFrame:
    e = repository.numbered(fixtures.read(spark, d, "embeddings").select("vec_id", "label"), "vec_id")
    items = e.select("idx", F.when(F.col("label") == 3, "").otherwise("x").alias("label"), (F.col("vec_id") % 2 != 0).alias("discarded"))
    return repository.next_pending(items, 7)


_NEW_USERS = f"""select user_id, 'USER' as role, {_T.format('min(ts)')} created_at, min_by(event_type, (ts, event_id)) first_event, {_T.format('max(ts)')} updated_at from events where user_id is not null group by user_id"""


def _shown(found: DataFrame) -> DataFrame:
    return found.withColumns({"created_at": ts("created_at"), "updated_at": ts("updated_at")})


@query(_NEW_USERS)
def new_user_profiles(spark: SparkSession, d: str) -> DataFrame:
    return _shown(profiles.profiles(profiles.fold(fixtures.read(spark, d, "events"))))


@query(_NEW_USERS)
def new_user_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same profiles from a stream, which is given all events twice."""
    schema, root = fixtures.read(spark, d, "events").schema, scratch.new_path(spark, "profiles")
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    profiles.start(stream.unionByName(stream), root, availableNow=True).awaitTermination()
    return _shown(profiles.stored(spark, root))


@query("""with o as (select o_orderkey id, o_orderkey % 4 k from orders)
select id document_id, case when k = 0 then null else 'a' end total_before, case when k = 0 then 'b' when k = 1 then null when k = 2 then 'a' else 'a' end total_after,
  case when k in (0, 1) then 'total' else '' end edited, k in (0, 1) manually_edited from o""")
def validation_payload(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    rows = fixtures.read(spark, d, "orders").select(
        F.col("o_orderkey").alias("document_id"), F.lit(5).alias("position"), F.lit("total").alias("field"), F.when(k != 0, "a").alias("extracted"),
        F.when(k == 0, "b").when(k == 2, "a").alias("corrected"), (k != 3).alias("touched"),
    )
    p = repository.validation_payload(rows)
    return p.select("document_id", F.col("original")["total"].alias("total_before"), F.col("validated")["total"].alias("total_after"), F.array_join("edited_fields", ",").alias("edited"), "manually_edited")


# --- visibility, deletion, activation ---


@query(f"with {DOCS} select id, status from docs where owner_id = 7")
def rls_owner(spark: SparkSession, d: str) -> DataFrame:
    p = fixtures.profiles(spark, d)
    return repository.visible(fixtures.documents(spark, d), 7, repository.is_admin(p, 7)).select("id", "status")


@query(f"with {DOCS} select id, status from docs")
def rls_owner_admin(spark: SparkSession, d: str) -> DataFrame:
    p = fixtures.profiles(spark, d)
    return repository.visible(fixtures.documents(spark, d), 100, repository.is_admin(p, 100)).select("id", "status")


@query(f"with {DOCS}, {RESULTS} select document_id, line_no, part from res where document_id in (select id from docs where owner_id = 7)")
def rls_via_parent(spark: SparkSession, d: str) -> DataFrame:
    return repository.visible_via_parent(fixtures.ocr_results(spark, d), fixtures.documents(spark, d), 7, False).select("document_id", "line_no", "part")


@query("""select 100 uid, vec_id sample_idx from embeddings""")
def rls_admin_only(spark: SparkSession, d: str) -> DataFrame:
    p, s = fixtures.profiles(spark, d), fixtures.descriptors(spark, d)
    seen = [repository.admin_only(s, repository.is_admin(p, u)).select(F.lit(u).alias("uid"), "sample_idx") for u in (100, 7)]
    return seen[0].unionByName(seen[1])


@query("select o_orderkey id, o_custkey = 7 can_read, o_custkey = 7 can_write from orders")
def rls_storage_prefix(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat_ws("/", F.col("owner_id").cast("string"), F.col("id").cast("string"), F.lit("original.png"))
    return fixtures.documents(spark, d).select("id", repository.path_visible(path, "7", False).alias("can_read"), repository.path_writable(path, "7").alias("can_write"))


@query(f"with {RESULTS} select document_id, count(*) n from res where document_id % 10 <> 0 group by 1")
def tombstone_antijoin(spark: SparkSession, d: str) -> DataFrame:
    gone = fixtures.documents(spark, d).where("id % 10 = 0").select("id")
    return repository.without_deleted(fixtures.ocr_results(spark, d), gone).groupBy("document_id").agg(F.count("*").alias("n"))


@query("""with e as (select o_custkey % 5 document_type, o_orderkey version, o_orderkey % 3 <> 0 active, o_orderkey stamp from orders)
select document_type, version from e qualify row_number() over (partition by document_type order by stamp desc) = 1 and active""")
def active_model(spark: SparkSession, d: str) -> DataFrame:
    o = fixtures.read(spark, d, "orders")
    events = o.select((F.col("o_custkey") % 5).alias("document_type"), F.col("o_orderkey").alias("version"), (F.col("o_orderkey") % 3 != 0).alias("active"), F.col("o_orderkey").alias("at"))
    return repository.active_model(events)


@query("select 'v' || p_partkey version, strftime(date '2024-01-01' + p_size, '%Y-%m-%d') created_at from part where p_type like '%BRASS%' or p_type = (select min(p_type) from part)")
def model_list(spark: SparkSession, d: str) -> DataFrame:
    """Models of one type out of many, without their samples."""
    p = fixtures.read(spark, d, "part")
    mine = F.col("p_type").like("%BRASS%") | (F.col("p_type") == p.agg(F.min("p_type")).scalar())
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size"))
    models = p.select(F.when(mine, "invoice_es").otherwise("other").alias("document_type"), F.concat(F.lit("v"), "p_partkey").alias("version"), day.cast("string").alias("created_at"), F.lit("{}").alias("model_data"))
    return repository.model_list(models, "invoice_es").select("version", "created_at")


def _uploads(spark: SparkSession, d: str) -> DataFrame:
    """(id, content, length, mime): PNG, JPEG and other bytes, declared as this and that, some missing or too large."""
    k = F.col("vec_id")
    head = F.when(k % 3 == 0, "89504E470D0A1A0A").when(k % 3 == 1, "FFD8FFE0").otherwise("74657874")
    content = F.when(k % 11 == 0, F.lit(None)).otherwise(F.concat(F.unhex(head), F.unhex(F.hex("label"))))
    length = F.when(k % 13 == 0, (11 << 20)).when(k % 17 == 0, 0).otherwise(F.octet_length(content))
    mime = F.when(k % 7 == 0, "image/gif").when(k % 5 < 3, "image/png").otherwise("image/jpeg")
    return fixtures.read(spark, d, "embeddings").select(k.alias("id"), content.alias("content"), length.cast("long").alias("length"), mime.alias("mime"))


_SNIFFED = """u as (select vec_id id, case vec_id % 3 when 0 then 'image/png' when 1 then 'image/jpeg' end found, vec_id % 11 = 0 gone, case when vec_id % 13 = 0 then 11534336 when vec_id % 17 = 0 then 0 else 9 end n,
  case when vec_id % 7 = 0 then 'image/gif' when vec_id % 5 < 3 then 'image/png' else 'image/jpeg' end mime from embeddings)"""


@query(f"""with {_SNIFFED} select id, case when gone or n = 0 then 'FILE_MISSING' when n > 10485760 then 'FILE_TOO_LARGE' when mime = 'image/gif' then 'MIME_NOT_ALLOWED' when found is distinct from mime then 'MIME_MISMATCH' end error,
  case mime when 'image/png' then 'png' else 'jpg' end extension from u""")
def upload_validation(spark: SparkSession, d: str) -> DataFrame:
    return _uploads(spark, d).select("id", images.upload_error(F.col("content"), F.col("length"), F.col("mime")).alias("error"), images.extension(F.col("mime")).alias("extension"))


@query(f"with {_SNIFFED} select id, case when not gone then found end mime from u")
def magic_sniff(spark: SparkSession, d: str) -> DataFrame:
    return _uploads(spark, d).select("id", images.sniff_mime(F.col("content")).alias("mime"))


@query("select p_partkey id, p_size * 20 * 480 >= 307200 ok from part")
def capture_resolution(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.read(spark, d, "part").select(F.col("p_partkey").alias("id"), images.enough_resolution(F.col("p_size") * 20, F.lit(480)).alias("ok"))


@query(f"with {DOCS} select id, case when id % 3 = 0 then 'rejected' else status end status from docs")
def status_updates(spark: SparkSession, d: str) -> DataFrame:
    docs = fixtures.documents(spark, d)
    third = docs.where("id % 3 = 0").select("id")
    events = third.select("id", F.lit("processing").alias("status"), F.lit(1).alias("at")).union(third.select("id", F.lit("rejected"), F.lit(2)))
    return repository.updated(docs, events).select("id", "status")
