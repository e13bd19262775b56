"""The engine's tables, derived from the test tables of `sf_dir` (no invoices exist there)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cents(price: Column) -> Column:
    return F.round(price * 100).cast("bigint")


def _money(c: Column) -> Column:
    return F.concat(F.floor(c / 100).cast("string"), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0"))


def amounts(orders: DataFrame) -> DataFrame:
    """Orders with valor, iva and total in cents."""
    valor = cents(F.col("o_totalprice"))
    iva = F.floor(valor * 19 / 100).cast("bigint")
    return orders.withColumns({"valor_c": valor, "iva_c": iva}).withColumn("total_c", F.col("valor_c") + F.col("iva_c"))


def _written(rows: DataFrame) -> DataFrame:
    """(doc_id, raw_text, lines): invoices with some keywords or lines missing, by `kind` from 0 to 6."""
    kind, nit = F.col("kind"), F.col("nit").cast("string")
    lines = [
        F.when(kind != 6, F.concat(F.lit("Proveedor: "), F.col("name"))),
        F.when(kind.isin(1, 6), nit).otherwise(F.concat(F.lit("NIT "), nit)),
        F.when(kind != 2, F.concat(F.when(kind != 6, "Fecha ").otherwise(""), F.col("day"))),
        F.concat(F.when(kind.isin(5, 6), "").otherwise("IVA "), _money(F.col("iva_c"))),
        F.concat(F.when(kind == 6, "").otherwise("Valor "), _money(F.col("valor_c"))),
        F.when(~kind.isin(4, 6), F.concat(F.when(kind == 3, "Total a pagar por el cliente ").otherwise("Total "), _money(F.col("total_c")))),
    ]
    texts = F.array_compact(F.array(*lines))
    boxed = F.transform(
        texts,
        lambda t, i: F.struct(
            t.alias("text"),
            F.struct(F.lit(0).alias("x"), (i * 25).alias("y"), F.lit(100).alias("width"), F.lit(20).alias("height")).alias("bbox"),
            F.lit(0.9).alias("confidence"),
        ),
    )
    return rows.select("doc_id", F.array_join(texts, "\n").alias("raw_text"), boxed.alias("lines"))


def _truth(rows: DataFrame) -> DataFrame:
    """(doc_id, field, value_str, value_num)."""
    none = F.lit(None)
    row = lambda f, s, n: F.struct(F.lit(f).alias("field"), s.cast("string").alias("value_str"), n.cast("double").alias("value_num"))
    fields = [row("proveedor", F.col("name"), none), row("nit", F.col("nit"), none), row("fecha", F.col("day"), none), *[row(f, none, F.col(f"{f}_c") / 100) for f in ("iva", "valor", "total")]]
    return rows.select("doc_id", F.inline(F.array(*fields)))


def _order_values(orders: DataFrame, customers: DataFrame) -> DataFrame:
    joined = amounts(orders).join(customers.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    return joined.select(
        F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 7).alias("kind"), F.col("c_name").alias("name"), (F.col("o_custkey") + 900000000).alias("nit"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "iva_c", "valor_c", "total_c",
    )


_ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, raw_text, lines) of the orders.

    The four narrow columns are dealt out before texts are made of them, since a small file is one
    partition and the work on each text is what takes time.
    """
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    orders = read(spark, sf_dir, "orders").select(*_ORDER_COLUMNS).repartition(tasks, "o_orderkey")
    return _written(_order_values(orders, read(spark, sf_dir, "customer")))


def invoice_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, field, value_str, value_num) of the orders."""
    return _truth(_order_values(read(spark, sf_dir, "orders").select(*_ORDER_COLUMNS), read(spark, sf_dir, "customer")))


def _supplier_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("s_suppkey") % 300).cast("int"))
    rows = s.select(
        F.col("s_suppkey").alias("doc_id"), (F.col("s_suppkey") % 7).alias("kind"), F.col("s_name").alias("name"), (F.col("s_suppkey") + 900000000).alias("nit"),
        F.date_format(day, "yyyy-MM-dd").alias("day"), F.abs(cents(F.col("s_acctbal"))).alias("valor_c"),
    )
    return rows.withColumn("iva_c", F.floor(F.col("valor_c") * 19 / 100).cast("bigint")).withColumn("total_c", F.col("valor_c") + F.col("iva_c"))


def supplier_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, raw_text, lines) of the suppliers, few enough to be drawn as pages and read again."""
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return _written(_supplier_values(spark, sf_dir).repartition(tasks, "doc_id"))


def supplier_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truth(_supplier_values(spark, sf_dir))


def images8(spark: SparkSession, sf_dir: str, table: str = "embeddings") -> DataFrame:
    """(img, x, y, v): an 8 x 8 image of each embedding."""
    px = read(spark, sf_dir, table).select(F.col("vec_id").alias("img"), F.posexplode("embedding").alias("p", "e"))
    v = F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("e").cast("double") + 1) * 127.5))).cast("int")
    return px.select("img", (F.col("p") % 8).cast("int").alias("x"), F.floor(F.col("p") / 8).cast("int").alias("y"), v.alias("v"))


def pictures8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, name, width, height, gray): the images of `images8`, a row each."""
    level = lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((e.cast("double") + 1) * 127.5)))
    gray = F.unhex(F.array_join(F.transform("embedding", lambda e: F.lpad(F.hex(level(e)), 2, "0")), ""))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.format_string("%d.png", "vec_id").alias("name"), F.lit(8).alias("width"), F.lit(8).alias("height"), gray.alias("gray"))


def binary8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of which value 255 marks what is over the middle grey."""
    return images8(spark, sf_dir).withColumn("v", F.when(F.col("v") >= 128, 255).otherwise(0))


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_idx, label, descriptor, dataset_partition)."""
    e = read(spark, sf_dir, "embeddings")
    part = F.when(F.col("vec_id") % 5 != 0, "train").otherwise("test")
    return e.select(F.col("vec_id").alias("sample_idx"), F.col("label").cast("string").alias("label"), F.col("embedding").alias("descriptor"), part.alias("dataset_partition"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, owner_id, document_type, status, created_at)."""
    o = read(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "uploaded").when(F.col("o_orderstatus") == "P", "processed").otherwise("validated")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner_id"), F.lit("invoice_es").alias("document_type"), status.alias("status"), F.col("o_orderdate").alias("created_at"))


def ocr_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, line_no, part, confidence, created_at, proveedor, total, processing_ms)."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("document_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part"),
        (1 - F.col("l_discount")).cast("decimal(4,3)").alias("confidence"),
        F.col("l_shipdate").alias("created_at"),
        F.concat(F.lit("Supplier#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")).alias("proveedor"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("total"),
        (F.col("l_quantity") * 10).cast("int").alias("processing_ms"),
    )


def extracted_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with JSON text in place of the flat values: totals of second lines are text, those of
    third lines are missing, fourth lines hold no JSON."""
    whole = ocr_results(spark, sf_dir)
    text = F.col("total").cast("string")
    total = F.when(F.col("line_no") == 2, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(text)
    tail = F.when(F.col("line_no") == 3, "}").otherwise(F.concat(F.lit(',"total":{"value":'), total, F.lit(',"confidence":0.95}}')))
    json = F.concat(F.lit('{"proveedor":{"value":"'), F.col("proveedor"), F.lit('","confidence":0.9}'), tail)
    return whole.withColumn("extracted_data", F.when(F.col("line_no") == 4, "none").otherwise(json)).drop("proveedor", "total")


def validations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, line_no, part, original, validated, manually_edited, validated_by, validated_at); JSON text.

    The narrow columns are dealt out before JSON is made and parsed, as in `invoices`."""
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    columns = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_tax", "l_returnflag", "l_shipdate")
    li = read(spark, sf_dir, "lineitem").where("l_returnflag in ('A', 'R')").select(*columns).repartition(tasks, "l_orderkey", "l_linenumber")
    total = cents(F.col("l_extendedprice"))
    edited = F.col("l_returnflag") == "R"
    fixed = F.when(edited, total + cents(F.col("l_tax"))).otherwise(total)
    proveedor = F.format_string("S%d", F.col("l_suppkey"))
    number = F.col("l_partkey").cast("string")
    json = lambda t, nit: F.concat(
        F.lit('{"proveedor":"'), proveedor, F.lit('","nit":'), nit, F.lit(',"iva":'), F.col("l_linenumber").cast("string"), F.lit(',"total":'), t.cast("string"), F.lit("}")
    )
    quoted = F.when(F.col("l_linenumber") == 3, F.concat(F.lit('"'), number, F.lit('"'))).otherwise(number)
    return li.select(
        F.col("l_orderkey").alias("document_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part"),
        json(total, number).alias("original"),
        json(fixed, F.when(edited, quoted).otherwise(number)).alias("validated"),
        (edited & (fixed != total) | edited & (F.col("l_linenumber") == 3)).alias("manually_edited"),
        F.col("l_suppkey").alias("validated_by"),
        F.col("l_shipdate").alias("validated_at"),
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, email, role)."""
    c = read(spark, sf_dir, "customer")
    role = F.when(F.col("c_custkey") % 100 == 0, "ADMIN").otherwise("USER")
    return c.select(F.col("c_custkey").alias("id"), F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))), F.lit("@example.com")).alias("email"), role.alias("role"))


def conversation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, raw_text, lines): the turns of each conversation as the lines of a document."""
    c = read(spark, sf_dir, "conversations").where("conv_id is not null")
    text = F.coalesce("text", F.lit(""))
    line = F.struct(F.col("turn").alias("t"), text.alias("text"))
    docs = c.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(line)).alias("l"))
    boxed = F.transform(
        "l",
        lambda x, i: F.struct(
            x["text"].alias("text"), F.struct(F.lit(0).alias("x"), (i * 25).alias("y"), F.lit(100).alias("width"), F.lit(20).alias("height")).alias("bbox"), F.lit(0.9).alias("confidence")
        ),
    )
    return docs.select("doc_id", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("raw_text"), boxed.alias("lines"))
