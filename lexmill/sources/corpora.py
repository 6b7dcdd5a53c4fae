"""Legal corpora made from ordinary tables, for queries and benchmarks whose results SQL can tell.

Each is a DataFrame (doc_id, source_name, text), or pages (doc_id, page_number, raw).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.chunks import spread


def _line(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _documents(rows: DataFrame, head: Column, line: Column, separator: str = "\n") -> DataFrame:
    """One text for each doc_id of rows (doc_id, n): a first line, then a line per row by n."""
    own = rows.withColumn("head", head).withColumn("line", line)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), separator)
    made = own.groupBy("doc_id").agg(F.min("head").alias("head"), body.alias("body"))
    return made.select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source_name"), F.concat_ws(separator, "head", "body").alias("text"))


def _numbered(rows: DataFrame, key: str, *order: str) -> DataFrame:
    own = spread(rows.withColumn("doc_id", F.col(key).cast("long")), "doc_id")
    return own.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))


def order_lines(lineitem: DataFrame) -> DataFrame:
    """doc_id (order), n (place in the order), l_partkey, l_suppkey, l_linenumber."""
    return _numbered(lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def statutes(lineitem: DataFrame, repeat_numbers: bool = False) -> DataFrame:
    """A part for each order, with an article for each of its lines. repeat_numbers: all are article 1."""
    number = F.lit(1) if repeat_numbers else F.col("n")
    article = _line("Article ", number, ". Supply of goods\nSupplier ", F.col("l_suppkey"), " delivers part ", F.col("l_partkey"), ".\n")
    return _documents(order_lines(lineitem), _line("Part 1. Obligations"), article)


def customer_orders(orders: DataFrame) -> DataFrame:
    """doc_id (customer), n (place among the customer's orders), o_orderkey."""
    return _numbered(orders.select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


def reviews(orders: DataFrame) -> DataFrame:
    """Court reviews: a preamble, then a numbered point for each of a customer's orders, each citing a decision."""
    point = _line(F.col("n"), ". Заказ рассмотрен судом. Определение Верховного Суда РФ от 5 мая 2023 г. № ", F.col("o_orderkey"), "-КГ.")
    return _documents(customer_orders(orders), _line("Обзор судебной практики.\n"), point)


FILLER = " The holder keeps a record of each step."


def rulebooks(supplier: DataFrame) -> DataFrame:
    """A lettered section for each nation, with a bare numbered rule for each of its suppliers."""
    rows = _numbered(supplier.select("s_nationkey", "s_suppkey"), "s_nationkey", "s_suppkey")
    return _documents(rows, _line("A. General principles"), _line(F.col("n"), ".\nSupplier ", F.col("s_suppkey"), " complies.", F.lit(FILLER * 30)))


def definitions(nation: DataFrame) -> DataFrame:
    """A schedule of definitions for each region."""
    rows = _numbered(nation.select("n_regionkey", "n_nationkey", "n_name"), "n_regionkey", "n_nationkey")
    return _documents(rows, _line("Schedule 1. Definitions"), _line('"', F.col("n_name"), '" means nation number ', F.col("n_nationkey"), "."))


def subdivided(supplier: DataFrame, style: str) -> DataFrame:
    """style "us": a rule with lettered subdivisions; "eu": an article with numbered ones, "recitals": a preamble.

    Each subdivision is longer than half a chunk, so no two share one.
    """
    rows = _numbered(supplier.select("s_nationkey", "s_suppkey"), "s_nationkey", "s_suppkey")
    label = _line("(", F.col("n"), ")") if style != "eu" else _line(F.col("n"), ".")
    head = {"us": "Rule 4. Summons", "eu": "Article 12", "recitals": "Having regard to the following:"}[style]
    return _documents(rows, _line(head), _line(label, " supplier ", F.col("s_suppkey"), " may act.", F.lit(FILLER * 20)))


def preambles(supplier: DataFrame) -> DataFrame:
    """A rulebook's title and a paragraph for each supplier of a nation."""
    rows = _numbered(supplier.select("s_nationkey", "s_suppkey"), "s_nationkey", "s_suppkey")
    return _documents(rows, _line("Virtual Markets Rulebook"), _line("supplier ", F.col("s_suppkey"), " is licensed."), "\n\n")


CITING = {
    "generic": (["Under Article ", " and Section ", " the order holds."], ["n", "o_orderkey"]),
    "us": (["See ", " U.S.C. § ", " for the order."], ["n", "o_orderkey"]),
    "eu": (["Recital ", " GDPR and Article ", " GDPR apply."], ["n", "o_orderkey"]),
    "ae": (["Article ", " VARA applies to ", "."], ["o_orderkey", "n"]),
    "ru": (["пункт ", " статьи ", " ГК РФ."], ["n", "o_orderkey"]),
    "families": (["Article ", " GDPR. This is followed at a distance by Article ", " EU Directive."], ["n", "o_orderkey"]),
}


def citing(orders: DataFrame, style: str) -> DataFrame:
    """A text for each order that cites by its numbers."""
    texts, columns = CITING[style]
    parts = [p for pair in zip(texts, [F.col(c) for c in columns], strict=False) for p in pair] + [texts[-1]]
    return customer_orders(orders).select(F.col("o_orderkey").cast("long").alias("doc_id"), F.concat(F.lit("doc-"), F.col("o_orderkey").cast("string")).alias("source_name"), _line(*parts).alias("text"))


def registry_pages(orders: DataFrame) -> DataFrame:
    """A page for each order of a customer, under one running head, with the page's number at its foot."""
    raw = _line("Registry of all orders\n", "Order ", F.col("o_orderkey"), " was placed\nand is kept on file.\n", F.col("n"))
    return customer_orders(orders).select("doc_id", F.col("n").alias("page_number"), raw.alias("raw"))


def contents_pages(orders: DataFrame) -> DataFrame:
    """Pages with as many lines of contents as the place among the customer's orders, modulo 3."""
    leader = F.concat(F.lit("Order list "), F.lit("." * 8), F.lit(" 7"))
    raw = _line("Orders like ", F.col("o_orderkey"), "\n", F.array_join(F.array_repeat(leader, F.pmod("n", F.lit(3)).cast("int")), "\n"), "\nwere placed before ", F.col("o_orderkey"), ".")
    return customer_orders(orders).select("doc_id", F.col("n").alias("page_number"), raw.alias("raw"))


def marker_pages(orders: DataFrame) -> DataFrame:
    """Pages whose letters and numerals stand on lines of their own."""
    raw = _line("A.\nOrder ", F.col("o_orderkey"), " terms\nIV.\nPart ", F.col("o_orderkey"), " Delivery\n\nGoods ", F.col("o_orderkey"), " are sent.")
    return customer_orders(orders).select("doc_id", F.col("n").alias("page_number"), raw.alias("raw"))
