"""Queries over the supplied tables, one or more for each operator, and the SQL that their results are held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric, text
from ..functions.vocabulary import FIELDS
from ..operators import clusters, confidence, extract, index, pages, report
from ..sources import files, tsv
from . import statements as st
from .statements import orders, table


def parse_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir).select("key", st.rendered(F.col("amount"), F.col("key")).alias("raw"))
    return o.withColumn("p", numeric.parse(F.col("raw"))).select("key", "raw", F.col("p.value").alias("value"), F.col("p.normalized").alias("normalized"), F.col("p.error").alias("error"))


def rejected_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts spoilt in seven ways, one by key, between bounds: what is told of each."""
    amount, key = F.col("amount").cast("string"), F.col("key") % 8
    spoilt = [F.concat(amount, F.lit(",5")), F.lit("n/a"), F.concat(amount, F.lit("x4")), F.concat(amount, F.lit(",5x")), F.concat(F.lit("9" + "0" * 20), amount), F.lit(None).cast("string"), F.concat(F.lit("-"), amount), F.concat(amount, F.lit("0" * 8))]
    o = orders(spark, sf_dir).select("key", F.get(F.array(*spoilt), key.cast("int")).alias("raw"))
    p = o.withColumn("p", numeric.parse(F.col("raw"), min_value=0, max_value=9_999_900_000_000))
    return p.select("key", "raw", F.col("p.value").alias("value"), F.col("p.error").alias("error"))


def fold_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(" ", "c_name", "c_mktsegment").alias("t"))
    return c.select("c_custkey", text.fold(F.col("t")).alias("folded"), text.token(F.col("t")).alias("token"))


def norm_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(" "), "p_name", F.lit(".: "), "p_type", F.lit(";-")).alias("t"))
    return p.select("p_partkey", text.header_key(F.col("t")).alias("header"), text.strip(F.col("t")).alias("stripped"))


def norm_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(" 00-"), F.col("c_custkey").cast("string"), F.lit(" / "), F.col("c_nationkey").cast("string"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", raw.alias("t"))
    return c.select("c_custkey", text.roster_id(F.col("t")).alias("roster_id"), text.index_id(F.col("t")).alias("index_id"), text.form_type(F.col("c_mktsegment")).alias("form_type"))


def detect_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc"), "text")
    both = d.unionByName(st.documents(orders(spark, sf_dir)).select(F.concat(F.lit("o"), "doc_id").alias("doc"), "text"))
    return both.select("doc", text.document_id(F.col("text")).alias("mb_key"))


def detect_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", text.index_year(F.col("text")).alias("year"), F.array_max(text.standalone_years(F.col("text"))).alias("standalone_year"))


def detect_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.documents(orders(spark, sf_dir)).select("doc_id", F.array_join(index.forms_of(F.col("text")), ",").alias("forms"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.entries_of(index.classify(st.documents(orders(spark, sf_dir))))


def latest_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.latest(_entries(spark, sf_dir)).select("mb_key", "form_type", "doc_id", F.col("period.year").alias("year"))


def roster_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = st.roster(spark, sf_dir).where("mb <> ''").select("row_index", index.roster_key(F.col("mb")).alias("mb_key"), F.explode(F.array(F.lit("bu"), F.lit("bs"))).alias("form_type"))
    found = rows.join(index.latest(_entries(spark, sf_dir)).select("mb_key", "form_type", "doc_id"), ["mb_key", "form_type"], "left")
    return found.select("row_index", "form_type", "doc_id")


def missing_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = index.latest(_entries(spark, sf_dir))
    return report.missing_documents(st.roster(spark, sf_dir), newest).select("row_index", "mb", "form_type")


def duplicate_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.duplicate_notes(_entries(spark, sf_dir)).select("mb_key", "form_type", F.col("ord").cast("long").alias("ord"), "note")


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes as intervals: each document of a company with several, the notes that list it, and its place in them."""
    found = index.registrations(_entries(spark, sf_dir))
    return found.select("mb_key", "form_type", *[F.col(c).cast("long").alias(c) for c in ("n", "ord", "place")], "path")


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.statements(orders(spark, sf_dir))


def lines_from_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = pages.whole_lines(_statements(spark, sf_dir))
    return lines.select(F.col("doc_id").cast("long").alias("key"), F.col("line").cast("long").alias("line"), "text", *[F.col(c).cast("long").alias(f"box_{c}") for c in ("left", "top", "right", "bottom")])


def page_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = confidence.page_confidence(st.words_of(_statements(spark, sf_dir)))
    return found.select(F.col("doc_id").cast("long").alias("key"), "page", F.round("confidence", 6).alias("confidence"))


def doc_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as pages, quantities as confidences; every third page has none."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity")).alias("confidence"))
    found = confidence.document_confidence(li)
    return found.select("doc_id", F.round("average_confidence", 6).alias("average_confidence"))


def numeric_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters.whole_clusters(_statements(spark, sf_dir))
    return found.select(F.col("doc_id").cast("long").alias("key"), F.col("cluster").cast("long").alias("cluster"), "text", F.col("left").cast("long").alias("left"), F.col("right").cast("long").alias("right"))


def column_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    banded = pages.whole_bands(_statements(spark, sf_dir)).select("doc_id", F.posexplode("bands").alias("band", "b"))
    return banded.select(F.col("doc_id").cast("long").alias("key"), F.col("band").cast("long").alias("band"), F.col("b.left").cast("long").alias("left"), F.col("b.right").cast("long").alias("right"), F.col("b.text").alias("text"))


def year_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.whole_features(_statements(spark, sf_dir), st.AS_OF)
    return found.select(F.col("doc_id").cast("long").alias("key"), *[F.col(f"columns.{c}.{e}").cast("long").alias(f"{c}_{e}") for c in ("current", "previous") for e in ("left", "right", "top")])


def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pages, headers on the first and, for even keys, on the third."""
    docs = orders(spark, sf_dir)
    late = F.when(F.col("key") % 2 == 0, "Текућа година").otherwise("ништа овде")
    whole = st.documents_of(docs, [st.headers()], [st.line(1, 40, (st.LABEL, "само текст"))], [st.line(1, 80, (st.CURRENT + 8, late))])
    found = extract.whole_features(whole, st.AS_OF)
    return found.select(F.col("doc_id").cast("long").alias("key"), F.col("page").cast("long").alias("page"), F.col("columns.current.left").cast("long").alias("current_left"), F.col("columns.current.page").cast("long").alias("from_page"), F.col("columns.previous").isNull().alias("no_previous"))


def _field(whole: DataFrame, *fields: str) -> DataFrame:
    return extract.whole_fields(whole, [FIELDS[f] for f in fields], st.AS_OF)


def _told(results: DataFrame, **more: Column) -> DataFrame:
    told = [F.col(f"result.{c}").alias(c) for c in ("value", "raw_text", "column_label")]
    return results.select(F.col("doc_id").cast("long").alias("key"), *told, F.size("result.errors").cast("long").alias("n_errors"), *[c.alias(k) for k, c in more.items()])


def extract_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(_field(_statements(spark, sf_dir), "revenue"))


def extract_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(_field(_statements(spark, sf_dir), "assets"))


def extract_capital_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.whole_loss(_statements(spark, sf_dir), [FIELDS["capital"], FIELDS["loss_row"]], st.AS_OF).withColumnRenamed("capital_loss", "result")
    return found.select(F.col("doc_id").cast("long").alias("key"), F.col("result.value").alias("value"), F.size("result.warnings").cast("long").alias("n_warnings"), F.get("result.warnings", 0)["context"]["source"].alias("source"))


def fallback_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = orders(spark, sf_dir)
    amount = F.col("amount").cast("string")
    whole = st.documents_of(docs, [st.headers(current=False), st.line(2, 100, (st.LABEL, "Пословни приходи"), (st.PREVIOUS, amount))])
    return _told(_field(whole, "revenue"), warning=F.get("result.warnings", 0)["code"])


def aop_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = orders(spark, sf_dir)
    whole = st.documents_of(docs, [st.line(1, 40, (st.CODE, "АОП"), (st.CURRENT, "Текућа година")), st.line(2, 160, (st.CODE, "1001"), (st.CURRENT, F.col("amount").cast("string")))])
    return _told(_field(whole, "revenue"))


def multiline_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = orders(spark, sf_dir)
    label = [st.line(i, 80 + 40 * i, (st.LABEL + 2 * i, w)) for i, w in enumerate(("Губитак", "изнад", "висине"), 2)]
    last = st.line(5, 280, (st.LABEL, "капитала"), (st.CURRENT, F.col("amount").cast("string")))
    return _told(_field(st.documents_of(docs, [st.headers(previous=False), *label, last]), "loss_row"))


def _run(spark: SparkSession, sf_dir: str, noted: bool = False) -> tuple[DataFrame, DataFrame]:
    """Roster and one row per roster row of a whole run, over the latest documents of all orders; with the index's notes if `noted`."""
    docs = orders(spark, sf_dir)
    classified = index.classify(st.documents(docs))
    newest = index.latest(index.entries_of(classified))
    needed = docs.join(newest.select("doc_id").distinct(), "doc_id", "left_semi")
    results = extract.whole_extract(st.statements(needed), st.AS_OF)
    roster = st.roster(spark, sf_dir)
    notes = index.index_notes(classified, roster.select(F.col("mb").alias("mb_key"))) if noted else None
    return roster, report.per_row(roster, report.field_rows(roster, newest, results, False), notes)


def upsert_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.upsert(_run(spark, sf_dir)[1]).select("row_index", "mb", "revenue", "assets", "capital_loss")


def exceptions_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.exceptions(_run(spark, sf_dir, noted=True)[1])


def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.counters(_run(spark, sf_dir)[1])


def content_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a cache of every fifth document's content lacks, by content hash."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha1(F.coalesce("text", F.lit("")).cast("binary")).alias("key"))
    cache = d.where("doc_id % 5 = 0").select("key").distinct()
    return d.join(cache, "key", "left_anti").groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))


def retry_best_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as attempts, quantities doubled as confidences."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("attempt"), (F.col("l_quantity") * 2).alias("confidence"))
    attempts = li.groupBy("doc_id", "attempt").agg(F.max("confidence").alias("confidence"))
    return confidence.best_attempts(attempts, 70.0).select("doc_id", F.col("attempt").cast("long").alias("attempt"), "confidence")


def parse_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word table per customer, with a blank line, a short row and an empty field."""
    key = F.col("c_custkey").cast("string")
    text_ = F.concat(F.lit("level\tleft\ttext\n5\t"), key, F.lit("\t"), "c_name", F.lit("\n\n5\t7\n4\t"), key, F.lit("\t\n"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("page"), text_.alias("tsv"))
    return tsv.parse(c).select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("row")["level"].alias("level"), F.col("row")["left"].alias("left"), F.col("row")["text"].alias("text"))


def page_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"))
    return pages.limited(li, 3).groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.max("page").cast("long").alias("last_page"))


def first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page"), "text")
    return pages.first_lines(d).select("doc_id", F.col("ord").cast("long").alias("ord"), "text")


def cache_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as versions of a cached payload: the newest stands."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("props").alias("payload"), F.col("ts").alias("created_at"), "event_id")
    old, new = e.where("event_id % 2 = 0").drop("event_id"), e.where("event_id % 2 = 1").drop("event_id")
    return files.merged(old, new).select("key", "payload")


QUERIES = {
    f.__name__: f
    for f in (
        parse_amounts, rejected_amounts, fold_tokens, norm_headers, norm_ids, detect_ids, detect_years, detect_forms, latest_document, roster_join, missing_documents, duplicate_notes, registrations, lines_from_words,
        page_confidence, doc_confidence, numeric_clusters, column_bands, year_columns, carry_forward, extract_revenue, extract_assets, extract_capital_loss, fallback_column, aop_fallback,
        multiline_anchor, upsert_results, exceptions_report, run_stats, content_hash_dedup, retry_best_of, parse_tsv, page_limit, first_lines, cache_merge,
    )
}
