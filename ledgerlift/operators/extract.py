"""Extraction of fields: anchors, columns and clusters of every page put together, and the first success per document.

Words are dealt by document and sorted by page; a task reads lots of whole pages as flat arrays, and gives out one small row
for each label that stands on a page. All after that, from the parsing of numbers on, is done on these rows."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.messages import MESSAGES
from ..functions.numeric import parse_with
from ..functions.text import bind, standalone_years
from ..functions.vocabulary import FIELDS, ROW_PATTERNS, Field
from ..schemas import BOX, COLUMN, MESSAGE
from .anchors import Anchor, Page, anchors_of
from .clusters import locate, located
from .columns import FIRST, HEADS, LEAST_YEAR, PARTIAL, Carried, chosen_of, code_column, dates_of, kind_of, reference_years, select_column, year_column
from .flat import NUMERIC, Alike, Band, Lot, bands_of_pages, fold, joined, lone_digits, lots, runs_of, token, whole, whole_alike
from .labels import Labels, labels_of
from .pages import arrow, rows_of, typed

NO_MESSAGES = f"array<{MESSAGE}>"
#: What is told of a document and a field.
RESULT = (
    f"struct<value:bigint,raw_text:string,normalized_text:string,page_number:int,anchor_text:string,anchor_bbox:{BOX},"
    f"column_label:string,column_bbox:{BOX},errors:{NO_MESSAGES},warnings:{NO_MESSAGES}>"
)
YEAR_COLUMNS = f"struct<current:{COLUMN},previous:{COLUMN}>"
#: Columns that hold on a page, and what stands next to a label on it.
FEATURES = f"doc_id string, page int, columns {YEAR_COLUMNS}, codes {COLUMN}"
ANCHOR = "struct<tier:int,ord:int,text:string,left:int,top:int,right:int,bottom:int>"
NEXT_TO = f"array<struct<page:int,columns:{YEAR_COLUMNS},a:{ANCHOR},candidates:array<string>,clusters:array<string>>>"
FOUND = f"doc_id string, page int, columns {YEAR_COLUMNS}, field string, a {ANCHOR}, candidates array<string>, clusters array<string>"


def message(code: str, text: Column | str, **context: Column) -> Column:
    entries = [x for k, v in context.items() for x in (F.lit(k), v.cast("string"))]
    found = F.create_map(*entries) if entries else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.struct(F.lit(code).alias("code"), (F.lit(text) if isinstance(text, str) else text).alias("message"), found.cast("map<string,string>").alias("context"))


def box_of(c: Column) -> Column:
    return F.when(c.isNotNull(), F.struct(*[c[n].alias(n) for n in ("left", "top", "right", "bottom")]))


def page_words(words: DataFrame, pages: DataFrame, as_of_year: int) -> DataFrame:
    """The words of whole documents, page by page, each with the year of its document: what features and fields are read from."""
    placed = typed(words).repartition("doc_id").join(reference_years(pages, as_of_year), "doc_id")
    return placed.sortWithinPartitions("doc_id", "page", "pos")


def prepared(lot: Lot, labels: Labels) -> tuple[list[tuple[set[str], set[str]]], list[str]]:
    """What is told from the texts of a lot's words and lines: labels of each line, and the lines' text. Labels are looked for once."""
    lot.clean, lot.numeric, lot.year_digits = lot.told(str.strip), lot.told(lambda t: bool(NUMERIC.search(t))), lot.told(lone_digits)
    tokens = [token(t) for t in lot.texts]
    lot.tokens = lot.each(tokens)
    lot.kinds = np.fromiter([kind_of(t, k) | (PARTIAL if labels.part.search(fold(t).lower()) else 0) for t, k in zip(lot.texts, tokens, strict=True)], np.int64, len(tokens))[lot.code]
    lot.starts = lot.line_start.tolist()
    lot.line_top, lot.line_bottom = lot.line_boxes()
    lines = [" ".join(lot.word_texts[a:b]).strip() for a, b in zip(lot.starts, lot.starts[1:], strict=False)]
    return [labels.found(line, fold(line)) for line in lines], lines


def pages_of_lot(lot: Lot, carried: Carried, labels: Labels, texts: bool = True) -> Iterator[tuple[int, Page, dict | None, tuple | None]]:
    """(number, page, columns, codes) of each page of a lot; pages without a word of any header or label have no need of bands, nor
    has any one of bands that hold none. Texts of columns are told if `texts`."""
    told, lines = prepared(lot, labels)
    starts, page_line, tokens = lot.page_start.tolist(), lot.page_line.tolist(), lot.tokens
    wanted = (np.bitwise_or.reduceat(lot.kinds, lot.page_start[:-1]) & HEADS) > 0
    dates = []
    for page, year in enumerate(lot.years):
        dates.append({number: label for label, number in dates_of(year).items()})
        if dates[-1] and not dates[-1].keys().isdisjoint(tokens[starts[page] : starts[page + 1]]):
            wanted[page] = True
            for w in range(starts[page], starts[page + 1]):
                if tokens[w] in dates[-1]:
                    lot.kinds[w] |= HEADS | FIRST[dates[-1][tokens[w]]]
        elif not wanted[page]:
            wanted[page] = any([possible for _, possible in told[page_line[page] : page_line[page + 1]]])
    bands, line_of = bands_of_pages(lot, wanted, lot.kinds), lot.line.tolist()
    for page, (doc_id, number, year) in enumerate(zip(lot.doc_ids, lot.page_numbers, lot.years, strict=True)):
        own: list[Band] = bands.get(page, [])
        headed = [b for b in own if b.kinds & HEADS]
        dated = [(w, lines[line_of[w]]) for w in range(starts[page], starts[page + 1]) if lot.year_digits[w] in dates[page]] if dates[page] else []
        columns = {label: year_column(label, number, year, headed, lot, dated, texts) for label in ("current", "previous")}
        on_page, codes = carried.on(doc_id, columns, code_column(number, headed, lot))
        yield page, Page(lot, page, own, told[page_line[page] : page_line[page + 1]]), on_page, codes


def as_rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def page_features(words: DataFrame, pages: DataFrame, as_of_year: int) -> DataFrame:
    """doc_id, page, columns and codes of every page with words: the columns that hold on it, its own ones or carried forward."""
    schema = arrow(FEATURES)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, labels = Carried(), labels_of(())
        for lot in lots(batches):
            yield as_rows([(lot.doc_ids[n], lot.page_numbers[n], column_dicts(columns), dict_of(codes)) for n, _, columns, codes in pages_of_lot(lot, carried, labels)], schema)

    return page_words(words, pages, as_of_year).mapInArrow(read, FEATURES)


def dated(documents: DataFrame, as_of_year: int) -> DataFrame:
    """rows_of with the year of each document, as reference_years tells it."""
    years = standalone_years(F.array_join("pages.text", "\n"))
    return rows_of(documents, (F.size("pages") > 0).alias("paged"), F.coalesce(F.array_max(years), F.lit(as_of_year)).alias("year"))


def structs(values: list[tuple | None], kind: pa.StructType) -> pa.StructArray:
    """Tuples as structs; what is itself a struct is a tuple too."""
    none = (None,) * kind.num_fields
    columns = list(zip(*[none if v is None else v for v in values], strict=True)) or [()] * kind.num_fields
    arrays = [structs(c, f.type) if pa.types.is_struct(f.type) else pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)]
    return pa.StructArray.from_arrays(arrays, fields=list(kind), mask=pa.array([v is None for v in values], pa.bool_()))


def pair(columns: dict | None) -> tuple | None:
    return columns and (columns["current"], columns["previous"])


def whole_features(documents: DataFrame, as_of_year: int) -> DataFrame:
    """What page_features tells, of documents that come whole."""
    schema = arrow(FEATURES)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, labels = Carried(), labels_of(())
        for _, lot, _ in whole(batches):
            told = [(pair(columns), codes) for _, _, columns, codes in pages_of_lot(lot, carried, labels)]
            ids = [pa.array(lot.doc_ids, pa.string()), pa.array(lot.page_numbers, pa.int32())]
            yield pa.RecordBatch.from_arrays([*ids, *[structs([t[i] for t in told], schema.field(2 + i).type) for i in (0, 1)]], schema=schema)

    return dated(documents, as_of_year).mapInArrow(read, FEATURES)


class Next(NamedTuple):
    """An anchor on a page of a standing row (numbered among those), and words of its text, of candidates and of all clusters, by their places in the row."""

    row: int
    page: int
    columns: tuple | None
    anchor: Anchor
    words: list[list[int]]
    candidates: list[list[int]]
    clusters: list[list[int]]


def next_to(like: Alike, strip: pa.Array, found: list[Next], kind: pa.ListType) -> pa.ListArray:
    """NEXT_TO of each row: what is found in the row that stands for it, with its own words. strip: like.texts, stripped."""
    struct, number = kind.value_type, lambda values: np.fromiter(values, np.int64)
    count = np.bincount(number(f.row for f in found), minlength=len(like.standing))
    of_row = count[like.of]
    entry, first = runs_of((np.cumsum(count) - count)[like.of], of_row), np.repeat(like.first[:-1], of_row)

    def texts(groups: list[list[list[int]]], values: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Of each group of runs of words: where it starts (and the end), and the text of each run."""
        runs = [run for group in groups for run in group]
        held, size, words = number(map(len, groups)), number(map(len, runs)), number(w for run in runs for w in run)
        own = runs_of((np.cumsum(held) - held)[entry], held[entry])
        at = words[runs_of((np.cumsum(size) - size)[own], size[own])] + np.repeat(np.repeat(first, held[entry]), size[own])
        return np.append(0, np.cumsum(held[entry])), joined(values.take(pa.array(like.code[at])), np.append(0, np.cumsum(size[own])), " ")

    taken = lambda values, type_: pa.array(values, type_).take(pa.array(entry))
    lists = lambda groups: pa.ListArray.from_arrays(pa.array((told := texts(groups, strip))[0], pa.int32()), told[1])
    spelt = texts([f.words for f in found], like.texts)[1]
    spelt = pa.array([t.strip() for t in spelt.to_pylist()], pa.string())
    anchor = struct.field("a").type
    places = [spelt if f.name == "text" else taken([getattr(n.anchor, f.name) for n in found], f.type) for f in anchor]
    columns = structs([f.columns for f in found], struct.field("columns").type).take(pa.array(entry))
    told = [taken([f.page for f in found], pa.int32()), columns, pa.StructArray.from_arrays(places, fields=list(anchor)), lists([f.candidates for f in found]), lists([f.clusters for f in found])]
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(of_row)), pa.int32()), pa.StructArray.from_arrays(told, fields=list(struct)), type=kind)


def whole_labelled(documents: DataFrame, anchors: dict[str, str], as_of_year: int, preferred: str) -> DataFrame:
    """doc_id, paged (whether it has pages) and for each field (by name, with its anchor) what labelled tells but the texts of columns, of documents that come whole."""
    ddl = "doc_id string, paged boolean" + "".join(f", {field} {NEXT_TO}" for field in anchors)
    schema, keys = arrow(ddl), tuple(sorted(set(anchors.values())))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, labels = Carried(), labels_of(keys)
        for rows, like, lot, row_of in whole_alike(batches, labels.digits, LEAST_YEAR):
            found: dict[str, list[Next]] = {field: [] for field in anchors}
            for n, page, columns, codes in pages_of_lot(lot, carried, labels, False) if lot else ():
                chosen, other = chosen_of(columns, preferred)
                ids, before, row = lot.held["id"], int(lot.before[n]), int(row_of[n])
                for field, key in anchors.items():
                    for a in anchors_of(page, key, labels):
                        words, *clusters = [a.words], *([c.words for c in held] for held in located(page, a, chosen, other, codes))
                        placed = [[[before + ids[w] for w in own] for own in held] for held in (words, *clusters)]
                        found[field].append(Next(row, lot.page_numbers[n], pair(columns), a, *placed))
            strip = pa.array([t.strip() for t in like.texts.to_pylist()], pa.string())
            lists = [next_to(like, strip, found[f], schema.field(f).type) for f in anchors]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("paged"), *lists], schema=schema)

    return dated(documents, as_of_year).mapInArrow(read, ddl)


def whole_results(documents: DataFrame, fields: list[Field], as_of_year: int, preferred: str = "current") -> DataFrame:
    """doc_id and a column for each field (by name) with its result: what read_fields tells, of documents that come whole.

    All that is told of a document stands in its row, in order of pages and anchors, so rows meet nowhere."""
    rows = whole_labelled(documents, defined_of(fields), as_of_year, preferred)
    return rows.select("doc_id", *[c.alias(k) for k, c in results_of(fields, preferred).items()])


def whole_loss(documents: DataFrame, fields: list[Field], as_of_year: int, preferred: str = "current") -> DataFrame:
    """whole_results, and capital_loss instead of capital and its row: the row is read only where capital tells nothing."""
    rows = whole_labelled(documents, defined_of(fields), as_of_year, preferred)
    results = results_of(fields, preferred)
    row = results.pop("loss_row")
    held = rows.select("doc_id", "paged", "loss_row", *[c.alias(k) for k, c in results.items()])
    return held.select("doc_id", *[k for k in results if k != "capital"], loss_above_capital(F.col("capital"), row).alias("capital_loss"))


def defined_of(fields: list[Field]) -> dict[str, str]:
    return {f.key: f.anchor for f in fields if f.anchor in ROW_PATTERNS}


def results_of(fields: list[Field], preferred: str) -> dict[str, Column]:
    """The result of each field (by name), of rows of whole_labelled."""
    none = F.array().cast(NO_MESSAGES)
    defined = defined_of(fields)
    bounds_of = lambda field: [F.lit(v).cast("bigint") for v in (field.min_value, field.max_value)]

    def told(field: Field) -> Column:
        least, most = bounds_of(field)

        def one(f: Column) -> Column:
            seen = lambda chosen: F.struct(f["page"].alias("page"), f["a"]["text"].alias("text"), box_of(f["a"]).alias("box"), chosen["column"].alias("column"), outcome(f["a"], f["page"], chosen, f, least, most).alias("told"))
            return bind(select_column(f["columns"], preferred), seen)

        return F.transform(field.key, one)

    def result(field: Field) -> Column:
        """Mostly the first candidate of the first anchor is a number; all others are read only where it is not."""
        if field.key not in defined:
            return whole(field, F.lit(None))
        first = F.get(field.key, 0)
        raw = F.get(first["candidates"], 0)
        at_once = lambda parsed: bind(select_column(first["columns"], preferred), lambda chosen: success_of(first["a"], first["page"], chosen, parsed, raw))
        return bind(parse_with(raw, *bounds_of(field)), lambda p: F.when(p["error"].isNull(), at_once(p)).otherwise(bind(told(field), lambda found: whole(field, found))))

    def whole(field: Field, found: Column) -> Column:
        last = lambda c: F.get(c, F.size(c) - 1)
        absent = message("anchor_not_found", MESSAGES["anchor_not_found"], anchor_key=F.lit(field.anchor)) if field.key in defined else message("anchor_definition_missing", MESSAGES["anchor_definition_missing"], anchor_key=F.lit(field.anchor))
        absent = F.array(F.when(~F.col("paged"), message("no_pages", MESSAGES["no_pages"])).otherwise(absent)).cast(NO_MESSAGES)
        nulls = dict.fromkeys(("value", "raw_text", "normalized_text", "page_number", "anchor_text", "anchor_bbox", "column_label", "column_bbox"), F.lit(None))
        failed = lambda **known: F.struct(*[v.alias(k) for k, v in (nulls | known | {"warnings": none}).items() if k != "errors" and k != "warnings"], known["errors"].alias("errors"), none.alias("warnings")).cast(RESULT)
        if field.key not in defined:
            return failed(errors=absent)
        end, column = last(found), last(F.filter(found, lambda t: t["column"].isNotNull()))["column"]
        errors = F.flatten(F.transform(found, lambda t: t["told"]["errors"]))
        seen = failed(page_number=end["page"], anchor_text=end["text"], anchor_bbox=end["box"], column_label=column["label"], column_bbox=box_of(column), errors=F.when(F.size(found) > 0, errors).otherwise(absent))
        # The first success wins and discards the errors before it; else all errors count, in order, with the last anchor and column seen.
        best = F.get(F.filter(found, lambda t: t["told"]["success"].isNotNull()), 0)["told"]["success"]
        return F.coalesce(best, seen)

    return {f.key: result(f) for f in fields}


def in_rows(wide: DataFrame, results: dict[str, Column]) -> DataFrame:
    """doc_id, field and result: a row for each."""
    listed = F.array(*[F.struct(F.lit(n).alias("field"), c.alias("result")) for n, c in results.items()])
    return wide.select("doc_id", F.explode(listed).alias("r")).select("doc_id", "r.field", "r.result")


def whole_fields(documents: DataFrame, fields: list[Field], as_of_year: int, preferred: str = "current") -> DataFrame:
    """doc_id, field and result of every document and field."""
    return in_rows(whole_results(documents, fields, as_of_year, preferred), {f.key: F.col(f.key) for f in fields})


def dict_of(row: tuple | None) -> dict | None:
    return None if row is None else row._asdict()


def column_dicts(columns: dict | None) -> dict | None:
    return columns and {label: dict_of(c) for label, c in columns.items()}


def labelled(placed: DataFrame, anchors: dict[str, str], preferred: str) -> DataFrame:
    """FOUND: for each field (by name, with its anchor) and anchor on a page of page_words, the numbers next to it."""
    schema, keys = arrow(FOUND), tuple(sorted(set(anchors.values())))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, labels = Carried(), labels_of(keys)
        for lot in lots(batches):
            rows = []
            for n, page, columns, codes in pages_of_lot(lot, carried, labels):
                chosen, other = chosen_of(columns, preferred)
                for field, key in anchors.items():
                    for a in anchors_of(page, key, labels):
                        told = {k: v for k, v in a._asdict().items() if k not in ("words", "fallback")}
                        rows.append((lot.doc_ids[n], lot.page_numbers[n], column_dicts(columns), field, told, *locate(page, a, chosen, other, codes)))
            yield as_rows(rows, schema)

    return placed.mapInArrow(read, FOUND)


def success_of(a: Column, page: Column, chosen: Column, parsed: Column, raw: Column) -> Column:
    none = F.array().cast(NO_MESSAGES)
    column, warning = chosen["column"], chosen["warning"]
    fields = {
        "value": parsed["value"], "raw_text": raw, "normalized_text": parsed["normalized"], "page_number": page, "anchor_text": a["text"], "anchor_bbox": box_of(a),
        "column_label": column["label"], "column_bbox": box_of(column), "errors": none, "warnings": F.when(warning.isNotNull(), F.array(warning)).otherwise(none),
    }
    return F.struct(*[v.alias(k) for k, v in fields.items()]).cast(RESULT)


def outcome(a: Column, page: Column, chosen: Column, found: Column, least: Column, most: Column) -> Column:
    """What an anchor gives: struct(success or null, errors) in the order in which candidates are tried."""
    none = F.array().cast(NO_MESSAGES)
    column, warning = chosen["column"], chosen["warning"]
    warned = F.when(warning.isNotNull(), F.array(warning)).otherwise(none)

    def success(parsed: Column, raw: Column) -> Column:
        return success_of(a, page, chosen, parsed, raw)

    def failure(error: Column, raw: Column) -> Column:
        return message("value_normalization_failed", error, page=page, raw_text=raw, anchor_text=a["text"])

    # A cell without numbers under a column is a blank, and a blank is 0.
    blank = bind(parse_with(F.lit(""), least, most), lambda p: F.struct(
        F.when(p["error"].isNull(), success(p, F.lit(""))).alias("success"),
        F.when(p["error"].isNotNull(), F.concat(F.array(failure(p["error"], F.lit(""))), warned)).otherwise(none).alias("errors"),
    ))
    texts = F.concat(F.lit("["), F.array_join(F.transform(found["clusters"], lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", "), F.lit("]"))
    bbox = F.concat(F.lit("("), F.concat_ws(", ", *[a[n].cast("string") for n in ("left", "top", "right", "bottom")]), F.lit(")"))
    unseen = message("value_not_found", MESSAGES["value_not_found"], page=page, anchor_text=a["text"], anchor_bbox=bbox, available_columns=warning["context"]["available_columns"], candidate_values=texts)
    nothing = F.struct(F.lit(None).cast(RESULT).alias("success"), F.array(warning, unseen).alias("errors"))

    def tried(all_: Column) -> Column:
        first = F.get(F.filter(F.transform(all_, lambda t, i: F.struct(i.alias("at"), t["parsed"]["error"].isNull().alias("ok"))), lambda t: t["ok"]), 0)["at"]

        def told(at: Column) -> Column:
            failed = F.slice(all_, F.lit(1), F.coalesce(at, F.size(all_)))
            each = F.transform(failed, lambda t: F.concat(F.when(column.isNull(), F.array(warning)).otherwise(none), F.array(failure(t["parsed"]["error"], t["raw"]))))
            best = F.get(all_, at)
            return F.struct(F.when(at.isNotNull(), success(best["parsed"], best["raw"])).alias("success"), F.flatten(each).alias("errors"))

        return bind(first, told)

    attempts = F.transform(found["candidates"], lambda t: F.struct(t.alias("raw"), parse_with(t, least, most).alias("parsed")))
    return F.when(F.size(found["candidates"]) > 0, bind(attempts, tried)).when(column.isNotNull(), blank).otherwise(nothing)


def read_fields(placed: DataFrame, documents: DataFrame, pages: DataFrame, fields: list[Field], preferred: str = "current") -> DataFrame:
    """doc_id, field and result of every document and field.

    placed is page_words; documents has doc_id; pages tells which documents have pages at all."""
    defined = [f for f in fields if f.anchor in ROW_PATTERNS]
    rows = labelled(placed, {f.key: f.anchor for f in defined}, preferred)
    bound = lambda name: F.coalesce(*[F.when(F.col("field") == f.key, F.lit(getattr(f, name)).cast("bigint")) for f in fields])
    rows = rows.withColumns({"chosen": select_column(F.col("columns"), preferred), "least": bound("min_value"), "most": bound("max_value")})
    rows = rows.withColumn("told", outcome(F.col("a"), F.col("page"), F.col("chosen"), F.struct("candidates", "clusters"), F.col("least"), F.col("most")))
    place = [F.col("page"), F.col("a.tier"), F.col("a.ord")]
    # The first success wins and discards the errors before it; else all errors count, in order, with the last anchor and column seen.
    agg = rows.groupBy("doc_id", "field").agg(
        F.min_by("told.success", F.when(F.col("told.success").isNotNull(), F.struct(*place))).alias("success"),
        F.array_sort(F.collect_list(F.struct(*[p.alias(n) for p, n in zip(place, "pto", strict=True)], F.transform("told.errors", lambda m: F.struct(m["code"], m["message"], F.map_entries(m["context"]).alias("entries"))).alias("errors")))).alias("errors"),
        F.max_by(F.struct(F.col("page").cast("int").alias("page"), F.col("a.text").alias("text"), box_of(F.col("a")).alias("box")), F.struct(*place)).alias("last"),
        F.max_by(F.struct(F.col("chosen.column.label").alias("label"), box_of(F.col("chosen.column")).alias("box")), F.when(F.col("chosen.column").isNotNull(), F.struct(*place))).alias("last_column"),
    )
    errors = F.transform(F.flatten(F.transform("errors", lambda e: e["errors"])), lambda m: F.struct(m["code"], m["message"], F.map_from_entries(m["entries"]).alias("context")))
    none = F.array().cast(NO_MESSAGES)
    names = [f.key for f in fields]
    wanted = documents.select("doc_id", F.explode(F.array(*[F.lit(n) for n in names])).alias("field"))
    paged = pages.select("doc_id").distinct().withColumn("paged", F.lit(True))
    told = wanted.join(agg.withColumn("errors", errors), ["doc_id", "field"], "left").join(paged, "doc_id", "left")
    key = F.lit("")
    for f in fields:
        key = F.when(F.col("field") == f.key, F.lit(f.anchor)).otherwise(key)
    undefined = F.col("field").isin([f.key for f in fields if f not in defined])
    absent = F.when(undefined & F.col("paged").isNotNull(), message("anchor_definition_missing", MESSAGES["anchor_definition_missing"], anchor_key=key)).when(F.col("paged").isNull(), message("no_pages", MESSAGES["no_pages"])).otherwise(message("anchor_not_found", MESSAGES["anchor_not_found"], anchor_key=key))
    fields_of = {
        "value": F.lit(None), "raw_text": F.lit(None), "normalized_text": F.lit(None), "page_number": F.col("last.page"), "anchor_text": F.col("last.text"), "anchor_bbox": F.col("last.box"),
        "column_label": F.col("last_column.label"), "column_bbox": F.col("last_column.box"), "errors": F.coalesce("errors", F.array(absent).cast(NO_MESSAGES)), "warnings": none,
    }
    failed = F.struct(*[v.alias(k) for k, v in fields_of.items()]).cast(RESULT)
    return told.select("doc_id", "field", F.coalesce("success", failed).alias("result"))


def success(result: Column) -> Column:
    return result["value"].isNotNull() & (F.size(result["errors"]) == 0)


def loss_above_capital(capital: Column, loss: Column) -> Column:
    """The derived field: what capital lies below zero; without it the loss row (else not computed); else the errors of both."""
    return F.when(success(capital), capital_below(capital)).otherwise(bind(loss, lambda row: row_for_capital(capital, row)))


def capital_below(capital: Column) -> Column:
    negative = F.when(capital["value"] < 0, -capital["value"]).otherwise(F.lit(0).cast("bigint"))
    by_formula = message("diagnostic_value_source", MESSAGES["capital_formula"], source=F.lit("capital_formula"), aop_code=F.lit("0401"), capital_value=capital["value"], computed_value=negative)
    return capital.withField("value", negative).withField("warnings", F.concat(capital["warnings"], F.array(by_formula))).cast(RESULT)


def row_for_capital(capital: Column, loss: Column) -> Column:
    codes = F.concat(F.lit("['"), F.array_join(F.transform(capital["errors"], lambda m: m["code"]), "', '"), F.lit("']"))
    missed = message("capital_extraction_failed", MESSAGES["capital_extraction_failed"], attempted_source=F.lit("capital_formula"), aop_code=F.lit("0401"), errors=codes)
    direct = message("diagnostic_value_source", MESSAGES["direct_row"], source=F.lit("direct_row"), aop_code=F.lit("0401"), computed_value=loss["value"])
    from_row = F.concat(loss["warnings"], F.when(F.size(capital["errors"]) > 0, F.array(missed)).otherwise(F.array().cast(NO_MESSAGES)), capital["warnings"], F.array(direct))
    row = loss.withField("warnings", from_row)
    nulls = [F.lit(None).alias(n) for n in ("value", "raw_text", "normalized_text", "page_number", "anchor_text", "anchor_bbox", "column_label", "column_bbox")]
    untold = message("value_not_found", MESSAGES["neither_source"], source_attempts=F.lit("['capital_formula', 'direct_row']"), aop_code=F.lit("0401"))
    every = F.concat(capital["errors"], loss["errors"])
    neither = F.struct(*nulls, F.when(F.size(every) > 0, every).otherwise(F.array(untold)).alias("errors"), F.concat(capital["warnings"], loss["warnings"]).alias("warnings")).cast(RESULT)
    return F.when(success(loss), row.cast(RESULT)).otherwise(neither)


def extract(words: DataFrame, pages: DataFrame, documents: DataFrame, as_of_year: int, preferred: str = "current") -> DataFrame:
    """doc_id, field (revenue, assets or capital_loss) and result of every document."""
    read = read_fields(page_words(words, pages, as_of_year), documents, pages, list(FIELDS.values()), preferred)
    wide = read.groupBy("doc_id").pivot("field", list(FIELDS)).agg(F.first("result"))
    return three(wide)


def three(wide: DataFrame) -> DataFrame:
    return in_rows(wide, {"revenue": F.col("revenue"), "assets": F.col("assets"), "capital_loss": loss_above_capital(F.col("capital"), F.col("loss_row"))})


def whole_extract(documents: DataFrame, as_of_year: int, preferred: str = "current") -> DataFrame:
    """What extract tells, of documents that come whole."""
    wide = whole_loss(documents, list(FIELDS.values()), as_of_year, preferred)
    return in_rows(wide, {f: F.col(f) for f in ("revenue", "assets", "capital_loss")})
